"""Streaming of the timeline engine."""
