"""lexigrow: grow lists of search terms from large text collections on Spark.

Every operator takes and returns a DataFrame; thresholds are keyword arguments.
"""

__version__ = "0.1.0"
