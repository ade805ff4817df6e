"""Operators for preparing large text and page collections for training."""
