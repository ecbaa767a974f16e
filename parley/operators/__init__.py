"""Operators of the conversation analytics engine."""
