"""Operators: functions from DataFrames (+ parameters) to a DataFrame."""
