"""fieldframe plans."""
