"""Operators for preparing large text corpora for training.

Nothing outside this package imports it.
"""
