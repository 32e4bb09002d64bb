"""Index maintenance as a stream."""
