"""Operators for training-data pipelines over tables of documents and conversations.

Nothing else in the library imports this subpackage.
"""
