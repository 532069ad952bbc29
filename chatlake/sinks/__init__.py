"""Writers for Parquet, JSON Lines, Markdown and manifests."""
