"""Operators of a training-data pipeline over corpora of raw documents.

Every operator takes and returns DataFrames and has its own general interface; the
registered queries (``queries.py``) are thin and derive their digest columns from it.
"""
