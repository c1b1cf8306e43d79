"""Readers, provenance hashes, digests and snapshots."""
