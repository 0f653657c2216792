"""Streaming of the network engine."""
