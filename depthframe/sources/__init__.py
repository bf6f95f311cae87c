"""Readers and writers of messages, configuration and results."""
