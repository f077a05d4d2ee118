"""Operators over documents, postings, vectors and logs."""
