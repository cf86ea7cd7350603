"""Operators: functions from DataFrames to DataFrames, lazy unless their docstring says otherwise."""
