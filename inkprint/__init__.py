"""Author-identification analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame. Posts stay long (one row per post) through
filters, joins and sampling, and are nested only at the write boundary.
"""

__version__ = "0.1.0"
