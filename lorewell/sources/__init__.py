"""Readers: documents in any supported format to one table of typed blocks."""
