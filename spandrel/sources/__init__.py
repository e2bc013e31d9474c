"""What can be compared: frames, files, catalog tables, Arrow and pandas objects."""
