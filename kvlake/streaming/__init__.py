"""streaming of kvlake."""
