"""Streaming of the conversation analytics engine."""
