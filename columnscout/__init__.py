"""columnscout: data discovery over a lake of tables, written for Spark.

Functions take DataFrames and return lazy DataFrames unless their docstring says
that they run a job (iterative operators and trained indexes do).
"""

__version__ = "0.1.0"
