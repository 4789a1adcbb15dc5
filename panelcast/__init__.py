"""Panel and time-series operators on Spark DataFrames.

A *panel* is one row per (series, period) with one numeric column per stage of a
flow.  Facts are aggregated to that grain before any window runs, so a window
partition is never larger than the calendar, however hot a series is.
"""
