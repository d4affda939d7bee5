"""Blueprints, settings, the batch engine and the query catalogue."""
