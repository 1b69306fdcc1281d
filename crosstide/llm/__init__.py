"""Operators for training-data preparation; each module holds one method and its contract."""
