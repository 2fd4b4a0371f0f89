"""Readers and writers for comment and title tables."""
