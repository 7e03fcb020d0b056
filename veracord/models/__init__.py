"""Language and embedding models: interfaces, and deterministic models that need no network."""
