"""Table readers, transcript readers and append sinks."""
