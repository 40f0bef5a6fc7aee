"""Sources and sinks: driver tables, derived views, archives, renderings, the store."""
