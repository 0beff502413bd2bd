"""Lineage operators over DataFrames."""
