"""Operators that prepare text, page and vector tables for model training.

Every operator is a function on DataFrames; ``queries`` registers one query for each.
Nothing outside this subpackage imports it.
"""
