"""Snapshots of a stream, compared batch by batch."""
