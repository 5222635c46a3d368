"""Extraction of definitions, imports, calls and inheritance from source texts."""
