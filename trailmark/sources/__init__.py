"""Table scans, staged tables and sinks."""
