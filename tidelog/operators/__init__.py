"""Operators over operation logs and manifests: DataFrames in, DataFrames out; ordered ones write ranges to the scratch folder."""
