"""Operators on free text for training data. Nothing outside imports this."""
