"""Column functions: identifiers, paths, patterns and labels."""
