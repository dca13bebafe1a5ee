"""Reading and writing tables and delimited files."""
