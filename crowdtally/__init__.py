"""crowdtally: annotation-study analytics on Spark DataFrames.

Modules: ``sources`` (tables, tweet JSON, test-data mapping), ``operators``
(consensus, scores, legacy, progress, feed, state, ingest, lookups, validate),
``functions`` (global ranking, slug), ``streaming`` (Structured Streaming
jobs) and ``plans`` (the registry of named queries with oracle SQL).
"""

__version__ = "0.1.0"
