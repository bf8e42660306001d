"""Append-only audit log as a stream."""
