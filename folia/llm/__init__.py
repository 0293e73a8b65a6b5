"""Operators of a training-data pipeline: extraction, counting, scoring,
packing, scanning, archiving, filtering, deduplication and decontamination.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames, selects only the columns it needs (so extra columns with
clashing names do no harm) and has its own parameters; the thin queries with
production parameters are in :mod:`folia.llm.queries`.
"""
