"""Operators of a training-data pipeline: deduplication, scoring, mixing,
packing and archive formats.  Nothing outside this subpackage imports it."""
