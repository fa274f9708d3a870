"""Training-data pipeline operators.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries when it can be imported. Each module holds one operator with its own
general interface; ``queries`` derives the digest columns from them.
"""
