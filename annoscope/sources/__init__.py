"""Sources and sinks: explicit schemas, never ``inferSchema``."""
