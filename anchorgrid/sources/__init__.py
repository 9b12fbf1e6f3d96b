"""Readers and writers with their schema checks."""
