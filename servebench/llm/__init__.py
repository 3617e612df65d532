"""Training-data operators: one module per operator, ``registry`` for the queries.

Nothing outside this package imports it (``__spark_entry__`` adds its queries
when it is there).
"""
