"""Operators of a training-data pipeline: dedup, scans, filters, archives, sharding and packing.

Nothing else in the library imports this subpackage; its registered queries
are in ``queries.py`` and the composed job is ``corpus_pipeline.py``.
"""
