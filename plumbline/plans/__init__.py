"""Queries over the test tables and their SQL, by operator group."""
