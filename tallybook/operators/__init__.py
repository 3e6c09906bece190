"""Reusable DataFrame operators: dedup, joins, roll-ups, ranking, merging, scoring."""
