"""Operators for preparing large text corpora for training.

Each module holds one operator; ``queries`` registers the ``opN_<name>``
queries and their SQL twins.  Nothing outside this subpackage imports it.
"""
