"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage. Beside PySpark, numpy and pyarrow
it uses pandas (labels of a sample), zstandard (packed texts), xxhash (page tokens) and,
in the query of token counts, the module that knows the vocabulary files' places.
"""
