"""Column functions: hashing, probabilities, text."""
