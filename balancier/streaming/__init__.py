"""Nothing here on purpose: every load and report of this library is a batch job.

A continuous load would call the functions of ``sources`` and ``operators.datamart``
from ``foreachBatch``; they take and return plain DataFrames.
"""
