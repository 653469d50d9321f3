"""Sources and sinks: typed CSV ingest, Parquet snapshots, the clicks view over events."""
