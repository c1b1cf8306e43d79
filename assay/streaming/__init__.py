"""Fixed windows of a stream as datasets."""
