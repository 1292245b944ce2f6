"""Auditing reported values against the evidence they cite, as Spark plans."""
