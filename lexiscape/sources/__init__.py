"""sources of lexiscape."""
