"""Operators for building training corpora from documents, web pages, conversations and benchmark items."""
