"""The per-story stages over streams."""
