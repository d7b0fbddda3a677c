"""Sources and sinks: matrices as text, as wide or array tables, and saved states of a fit.

Inside the engine a matrix is a table of coordinates ``row_id, col_id, val``
without zeros; a response is ``row_id, y``.
"""
