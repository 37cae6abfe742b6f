"""Operators: knowledge base, mentions, candidates, features, labels."""
