"""Operators for preparing training data, their queries and SQL checks.

Nothing else in the library imports this subpackage. Each module is one operator with a
general interface; ``queries`` applies them to the given tables.
"""
