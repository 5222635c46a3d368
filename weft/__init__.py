"""weft: a Spark-first analytics engine for code-knowledge graphs and text corpora."""

__version__ = "0.1.0"
