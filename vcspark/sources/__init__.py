"""Readers, writers and the shared work area."""
