"""Operators for preparing training data at scale.

Nothing else in the library imports this subpackage. ``queries`` holds the
registered queries and ``common`` the few helpers that the operators share.
"""
