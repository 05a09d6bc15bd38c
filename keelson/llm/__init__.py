"""Operators for building training corpora.  Nothing else in keelson imports this package."""
