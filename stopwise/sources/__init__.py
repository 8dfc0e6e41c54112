"""Readers and writers: timetable feeds, networks, realtime snapshots, bike feeds, notices, documents."""
