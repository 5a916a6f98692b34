"""Training-data operators over a ``documents`` table (doc_id, text, ...).

Nothing else in the library imports this subpackage.  Each operator module has a general
entry point that takes and returns DataFrames; ``queries.py`` has the thin digest queries.
"""
