"""Operators on snapshots, events and addresses: DataFrames in, DataFrames out."""
