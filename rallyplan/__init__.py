"""rallyplan: a Spark-first analytics engine for court-sport tracking facts."""

__version__ = "0.1.0"
