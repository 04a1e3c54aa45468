"""Operators for building language-model training data.

Nothing outside this subpackage imports it; the queries that apply the operators
to whole tables are in :mod:`ledgerfold.llm.queries`.
"""
