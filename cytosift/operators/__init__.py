"""Relational operators over reads, sites, and intervals."""
