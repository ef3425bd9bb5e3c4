"""streaming of lexiscape."""
