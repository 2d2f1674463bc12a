"""Structured Streaming forms: the interval scorer over an event-line stream and the
image classifier over an image-line stream."""
