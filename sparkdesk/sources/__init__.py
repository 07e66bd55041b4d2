"""Reading and writing ticket tables, fitted models and the model registry."""
