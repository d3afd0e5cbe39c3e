"""Column functions over texts and vectors."""
