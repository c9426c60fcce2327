"""Readers and writers for column files, query sets and result tables."""
