"""Column functions: scores, text, time parts and statistics."""
