"""Full-text retrieval over Spark DataFrames: analysis, query language, BM25, segments."""

__version__ = "0.1.0"
