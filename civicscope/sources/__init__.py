"""Files in and out: text sources, Parquet tables, freshness and the shared work folder."""
