"""Reading and writing documents in file formats."""
