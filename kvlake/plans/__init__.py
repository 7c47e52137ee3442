"""plans of kvlake."""
