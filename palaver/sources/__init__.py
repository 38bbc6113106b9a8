"""Readers and adapters that end in the message model."""
