"""Column functions: text, geometry, normalisation, hashing, image features."""
