"""Spark-native news and document analytics.

``functions``  column expressions, ``sources`` scans and sinks, ``operators``
relational operators, ``plans`` multi-step queries with their SQL oracles,
``streaming`` Structured Streaming forms, ``llm`` training-data operators.
"""
