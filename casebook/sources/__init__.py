"""Sources and sinks: driver tables, adapter views, derived record texts, file ingest."""
