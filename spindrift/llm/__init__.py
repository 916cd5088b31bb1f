"""Training-data operators: ten set, text, vector, sampling and format operators.

Nothing else in the library imports this subpackage.  Each module holds one
operator; ``queries`` binds them to whole tables and holds their SQL.
"""
