"""plans of lexiscape."""
