"""Operators over the logical tables (see lodestone.schema): DataFrames in, DataFrames out, nothing collected."""
