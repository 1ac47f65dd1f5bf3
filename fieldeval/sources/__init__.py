"""Readers and writers for truth tables, result files and image inventories."""
