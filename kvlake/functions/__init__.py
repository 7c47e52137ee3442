"""functions of kvlake."""
