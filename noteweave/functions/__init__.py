"""noteweave functions."""
