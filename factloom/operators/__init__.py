"""Operators over entities, facts, provenance and edges. All take and give DataFrames."""
