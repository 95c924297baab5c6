"""Operators for large training-data pipelines: one module per operator, queries in ``queries``.

Nothing else in the package imports this subpackage. Every operator takes DataFrames, selects only the columns
it names (so extra columns, whatever their names, cannot clash) and returns a DataFrame.
"""
