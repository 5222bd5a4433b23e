"""Column functions: text, vectors, spectral factors."""
