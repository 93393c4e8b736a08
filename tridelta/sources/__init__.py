"""Readers and writers: coordinate text, derived tensors, model tables."""
