"""Feeds, stores and timetables as DataFrames."""
