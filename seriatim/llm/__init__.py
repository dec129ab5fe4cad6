"""Operators of a training-data pipeline over documents, pages and embeddings.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin
``opN_<name>`` queries, the other modules the operators behind them.
"""
