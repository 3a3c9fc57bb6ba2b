"""tidemark: a Spark-native engine for market time series.

Bars and funding events live in DataFrames; quality gates, the position ledger, funding
joins and risk metrics are declared as DataFrame plans that Catalyst optimises.
"""

__version__ = "0.1.0"
