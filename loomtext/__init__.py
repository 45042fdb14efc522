"""loomtext: Spark-first analytics over multilingual parallel-text corpora."""

__version__ = "0.1.0"
