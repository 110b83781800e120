"""Operators for training-data problems on texts and names; nothing outside imports this package."""
