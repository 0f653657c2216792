"""Plans of the network engine."""
