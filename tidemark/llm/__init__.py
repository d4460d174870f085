"""Training-data operators: deduplication, decontamination, filtering, scoring, packing.

Nothing outside this package imports it. Every operator takes and returns DataFrames;
the ``opN_<name>`` queries in :mod:`tidemark.llm.registry` apply them to the test tables.
"""
