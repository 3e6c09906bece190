"""Operators of a training-data pipeline: media, near-duplicates, filters, packing, language ID."""
