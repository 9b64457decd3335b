"""fieldframe streaming."""
