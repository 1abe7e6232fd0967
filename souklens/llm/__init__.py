"""Operators of a training-data pipeline: cleaning, de-duplication, tokens, sharding and packing.

Nothing else in the library imports this subpackage."""
