"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage, the entry module and the pipeline at the
repository top imports it.
"""
