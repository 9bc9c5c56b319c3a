"""Operators for training-data pipelines over description rows, with their registered queries.

Every operator reads the library's own records: description rows (row_id, description), vector
points (point_id, vector) or, where the library has no such record, general tables. Nothing else
in the library imports this subpackage.
"""
