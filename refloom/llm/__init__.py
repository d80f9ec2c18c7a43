"""Training-data operators: thirteen DataFrame operators for large text corpora.

Nothing else in the package imports this subpackage.
"""
