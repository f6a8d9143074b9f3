"""Graph operators: functions from a GraphStore's tables to DataFrames."""
