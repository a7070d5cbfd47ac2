"""Operators for building training corpora from documents and pages."""
