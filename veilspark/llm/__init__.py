"""Operators of a training-data pipeline: dedup, decontamination, mixing, scoring, formats.

Nothing outside this package imports it.  ``queries`` registers one query per operator.
"""
