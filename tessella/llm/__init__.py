"""Operations of a training-data pipeline, each on DataFrames.

Nothing else in the library imports this subpackage.  The queries that apply
the operators to whole tables are in :mod:`tessella.llm.queries`.
"""
