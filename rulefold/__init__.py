"""Rules over changing keyed tables, evaluated as ordinary Spark DataFrames."""
