"""Column functions: words, lines and plain text."""
