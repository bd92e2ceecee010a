"""Training-data operators: text statistics, deduplication, extraction, packing and mixing.

Every operator takes a DataFrame and column names and returns a DataFrame with
the id column and its own output columns, unless its docstring says otherwise.
Input columns that are not named in the call are ignored, so their names can
never clash with an output column. Nothing outside this package imports it.
"""
