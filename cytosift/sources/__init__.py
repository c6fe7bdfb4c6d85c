"""Readers and writers of genomics files, and the synthetic source of the driver's queries."""
