"""Column builders: text, labels, scoring and prompt templates."""
