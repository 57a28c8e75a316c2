"""Operators for training-data pipelines over document tables.

Nothing outside this subpackage imports it. Each module holds one operator with
a general interface; ``queries`` binds them to the given tables.
"""
