"""Operators for building language-model training data.

Nothing outside this subpackage imports it.  Each module holds one operator;
``queries`` registers the contract queries on top of them.
"""
