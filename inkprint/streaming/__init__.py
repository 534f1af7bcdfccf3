"""Record streams: the stateless post preparation, applied to an unbounded input."""
