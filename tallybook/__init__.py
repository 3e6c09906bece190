"""Tallybook: public-accountability analytics expressed as Spark jobs."""
