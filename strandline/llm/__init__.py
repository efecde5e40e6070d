"""Training-data operators: each module holds one operator and its query.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries only where it can be imported.
"""
