"""Sources and sinks: parquet tables, star lists, JSON-lines record files, git log exports, blobs."""
