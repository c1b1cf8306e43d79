"""Guards over parsed SQL plans."""
