"""Queries and folds over a keyed object store, as functions from DataFrame to DataFrame."""
