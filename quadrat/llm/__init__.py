"""Training-data operators: archive records, decontamination, quality rules,
packing, license scans, personal data, substring dedup, token files, quality
scores and n-gram similarity joins.

Nothing outside this package imports it. Each operator module states its
results for nulls, empty and very long texts, ties, repeated rows, empty tables
and extra columns in its docstring.
"""
