"""fieldframe sources."""
