"""Sources and sinks: CSV import, Parquet table, fixture view, marts."""
