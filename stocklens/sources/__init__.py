"""Sources and sinks: role tables in, tables out."""
