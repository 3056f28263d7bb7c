"""Writers: canonical CSV, Parquet, hashed packages, linked data and sitemaps."""
