"""Motif analytics as DataFrame operators; see README.md."""
