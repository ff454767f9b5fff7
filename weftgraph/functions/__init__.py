"""Column functions, and text functions of documents."""
