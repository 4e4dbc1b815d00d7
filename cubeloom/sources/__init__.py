"""Cubes: tables of one row for each cell and time, how they are read, written, shaped and made dense."""
