"""Streams of snapshots, records and audit days; each has a batch query of the same result."""
