"""Audit analytics for recorded LLM calls, written as PySpark DataFrame jobs.

Every public function takes DataFrames (or column expressions) and returns
DataFrames (or column expressions).  Unknown is NULL everywhere and is never
replaced by zero.
"""

__version__ = "0.1.0"
