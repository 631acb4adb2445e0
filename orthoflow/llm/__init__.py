"""Operators for training-data pipelines over whole document tables.

Nothing else in the library imports this subpackage. Every operator takes a DataFrame and the
names of the columns it needs; other columns are ignored unless the docstring says they pass
through, so extra columns with any name are harmless.
"""
