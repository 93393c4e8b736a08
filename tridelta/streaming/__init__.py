"""Micro-batch driver for increments arriving as a stream."""
