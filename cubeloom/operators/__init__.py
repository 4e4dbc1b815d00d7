"""Operators over cubes and station tables; each takes DataFrames and returns one."""
