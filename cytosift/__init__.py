"""Bisulfite methylation analytics as Spark DataFrame plans."""
