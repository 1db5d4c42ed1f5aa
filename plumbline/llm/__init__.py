"""Operators for preparing large training corpora.

Nothing outside this subpackage imports it; ``queries`` lists the registered
queries and their SQL.
"""
