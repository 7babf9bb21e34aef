"""Operators of a training-data pipeline: scoring, scanning, counting, packing, de-duplication and file formats.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; ``queries.py`` registers one thin query for each.
"""
