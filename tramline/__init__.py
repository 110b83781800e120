"""Timetable-feed analytics as declarative Spark plans."""
