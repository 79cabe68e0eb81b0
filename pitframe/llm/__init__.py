"""Operators for preparing training data at scale.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; the ``opN_`` queries in :mod:`pitframe.llm.queries` apply
them to whole tables.
"""
