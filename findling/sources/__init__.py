"""Table, file and index readers and writers."""
