"""Whole jobs: configured preparation, dataset recipes, models and experiments."""
