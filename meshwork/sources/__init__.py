"""Sources of the network engine."""
