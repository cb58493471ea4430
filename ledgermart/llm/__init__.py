"""Operators of a training-data pipeline, one module each.

Nothing outside this subpackage imports it.  Every operator is a function
on DataFrames with its own parameters; :mod:`ledgermart.llm.catalog` holds
the thin ``opN_<name>`` queries over the test tables and their SQL.
"""
