"""noteweave operators."""
