"""Commands as a stream."""
