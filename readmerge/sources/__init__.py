"""Reading and writing sequence files."""
