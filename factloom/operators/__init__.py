"""Relational operators over facts, documents, candidates and graphs."""
