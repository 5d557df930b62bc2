"""Scans of tables, files and logs."""
