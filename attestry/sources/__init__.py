"""Pages and facts from tables."""
