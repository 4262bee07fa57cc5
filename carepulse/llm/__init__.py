"""Operators of a training-data pipeline (text quality, dedup, tokenizing, ...).

Nothing else in the library imports this subpackage.
"""
