"""noteweave streaming."""
