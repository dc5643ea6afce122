"""Operators for preparing training data; nothing else in skein imports this."""
