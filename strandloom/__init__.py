"""strandloom: DataFrame operators for barcoded read tables, sequences, intervals and counts.

Every operator is a function of DataFrames with column names as parameters and returns a lazy
DataFrame. Nothing here keeps global state or starts a session.
"""

__version__ = "0.1.0"
