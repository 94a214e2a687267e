"""codesift: a Spark-native engine for code, review and text collections.

Every operator is a function from DataFrames to a DataFrame.  Nothing here
keeps global state; a caller passes in tables and gets a lazy plan back.
"""

__version__ = "0.1.0"
