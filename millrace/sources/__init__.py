"""Sources and sinks: Parquet tables, versioned tables and directory listings."""
