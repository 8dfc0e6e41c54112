"""Training-data operators: similarity joins, search, scoring, filtering, packing.

Nothing outside this subpackage imports it, and it imports nothing from the
rest of the library.  Each operator has a module of its own with a general
interface; ``queries.py`` binds them to the corpus tables.
"""
