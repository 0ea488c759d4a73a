"""noteweave: knowledge-base retrieval and feedback analytics as Spark DataFrame plans."""

__version__ = "0.1.0"
