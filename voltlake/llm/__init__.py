"""Operators of a training-data pipeline over `documents` and `pages`; nothing else in voltlake imports them."""
