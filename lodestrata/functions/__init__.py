"""Column-level functions: text, vectors, references, JSON and labels."""
