"""Readers and writers: game files, split tables, profiled files, file inventory, run tables."""
