"""Corpus operators: event runs, percentiles, token ids, mixing, subject areas.

Nothing outside this sub-package imports it.
"""
