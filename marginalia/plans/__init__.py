"""Driver-side planning: privacy, factors, inference, selection."""
