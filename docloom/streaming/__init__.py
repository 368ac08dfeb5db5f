"""Continuous synchronisation."""
