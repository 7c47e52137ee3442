"""sources of kvlake."""
