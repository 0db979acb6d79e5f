"""Operators of a training-data pipeline: decontamination, licences, deduplication, mixing, output.

Nothing outside this package imports it. Every operator takes DataFrames and column names and
returns DataFrames; ``queries`` registers one query per operator with production parameters.
"""
