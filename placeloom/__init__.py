"""placeloom: place retrieval over event streams and descriptor banks, as DataFrame plans."""
