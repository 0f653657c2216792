"""Functions of the network engine."""
