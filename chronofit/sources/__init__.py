"""Raw files, table sources and sinks."""
