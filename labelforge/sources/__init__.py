"""Sources and sinks: parquet tables, derived inputs, CSV/JSON/Markdown files."""
