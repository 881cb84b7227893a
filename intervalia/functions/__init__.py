"""Part of the intervalia package."""
