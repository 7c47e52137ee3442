"""operators of kvlake."""
