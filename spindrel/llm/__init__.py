"""Operators for preparing training corpora.

Nothing else in the library imports this subpackage.  Each operator has a
module of its own; ``queries`` registers the thin queries over the tables.
"""
