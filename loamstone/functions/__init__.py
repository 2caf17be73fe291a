"""Column functions: text, chunking, ranking and time."""
