"""Graph operators: functions from DataFrames to DataFrames."""
