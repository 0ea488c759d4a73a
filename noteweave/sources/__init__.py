"""noteweave sources."""
