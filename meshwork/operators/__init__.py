"""Operators of the network engine."""
