"""Training-data operators: dedup, decontamination, scoring, formatting and token output.

Nothing outside this subpackage imports it.
"""
