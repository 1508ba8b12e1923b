"""Operators over source files: extraction, classification, registry, statistics, store."""
