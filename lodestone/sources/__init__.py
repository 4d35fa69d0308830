"""Sources: source trees, documents, references, gold sets, replies."""
