"""Files as sources and sinks."""
