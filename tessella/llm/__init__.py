"""Operators for preparing training data: archives, near copies, tokens, quality, chat."""
