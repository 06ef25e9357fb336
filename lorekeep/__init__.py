"""Conversation-memory analytics on Spark."""
