"""Where graphs go: JSON, YAML, Mermaid and DOT."""
