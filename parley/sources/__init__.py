"""Sources of the conversation analytics engine."""
