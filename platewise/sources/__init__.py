"""Table readers, importers and writers."""
