"""operators of lexiscape."""
