"""Composed jobs: training loaders, model fitting, table scoring."""
