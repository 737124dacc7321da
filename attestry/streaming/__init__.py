"""Relationships kept up to date as pages arrive."""
