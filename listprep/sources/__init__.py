"""Scans, header resolution and rule tables."""
