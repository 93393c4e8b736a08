"""Stages and the whole update."""
