"""Streams of messages into tables."""
