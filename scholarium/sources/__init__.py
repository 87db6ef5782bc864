"""Readers and writers for files whose headers drift."""
