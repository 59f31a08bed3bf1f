"""Retail analytics expressed as Spark DataFrame jobs.

Every operator is a function ``DataFrame[s] + parameters -> DataFrame`` that
computes its result for all customers / products / events at once.  Nothing
is collected to the driver; ``as_of`` instants are explicit parameters.
"""

__version__ = "0.1.0"
