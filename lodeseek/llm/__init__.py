"""Operators for preparing training data.  Nothing outside this folder imports it.

Each module holds one operator; ``queries.py`` binds them to the driver's tables.
"""
