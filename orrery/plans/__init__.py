"""Declarative table definitions, the dependency graph and the pipeline runner."""
