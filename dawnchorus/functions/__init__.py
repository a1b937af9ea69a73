"""Column functions: text, paths, file-name patterns, packed vectors."""
