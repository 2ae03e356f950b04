"""Readers, writers and the projections of the generic tables onto the domain tables."""
