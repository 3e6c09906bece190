"""Readers that turn messy public records into typed DataFrames."""
