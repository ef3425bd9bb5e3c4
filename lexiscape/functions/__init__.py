"""functions of lexiscape."""
