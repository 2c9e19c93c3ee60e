"""Burst, frame and language analytics over time-partitioned short texts, on Spark DataFrames."""
