"""Readers for raw exports, parsed threads, manifests and Parquet tables."""
