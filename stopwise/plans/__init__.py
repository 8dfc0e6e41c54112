"""Analyses over transit tables; each takes and returns DataFrames."""
