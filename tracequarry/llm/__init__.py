"""Training-data operators. Nothing else in the library imports this subpackage.

Every module holds one operator with a general interface and one thin
``opN_*`` query that derives the digest columns from the operator's output.
"""
