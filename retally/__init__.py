"""Event rollups on Spark: daily views of a keyed event table, kept current from its changes.

All public functions take and return DataFrames; nothing is executed until the caller
runs an action, except where a docstring says so.
"""
