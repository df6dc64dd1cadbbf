"""Structured Streaming forms of the live quiz and activity flow."""
