"""Structured Streaming: frames and events."""
