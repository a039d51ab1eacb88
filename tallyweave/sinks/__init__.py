"""Outputs of findings and packets."""
