"""Operators for preparing training data at scale: each module holds one operator."""
