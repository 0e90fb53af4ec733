"""Operators for building training data from large text collections.

Nothing outside this folder imports it; ``queries.py`` lists what it registers.
"""
