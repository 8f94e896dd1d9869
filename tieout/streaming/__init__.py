"""Watching a folder for deliveries."""
