"""Training-data pipeline operators.

Nothing outside this subpackage imports it.  Every operator takes a documents
DataFrame and reads only the id and text columns it is told to (``id_col``,
``text_col``); other columns, whatever their names, are never touched, so they
cannot clash with result columns.
"""
