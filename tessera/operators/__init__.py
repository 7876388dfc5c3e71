"""Operators on layout relations: each takes DataFrames and returns one."""
