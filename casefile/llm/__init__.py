"""Operators for preparing language-model training data.

Each module is one operator with its own general interface; ``queries`` binds
them to the test tables.  Nothing else in the library imports this subpackage.
"""
