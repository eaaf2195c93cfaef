"""All registered queries."""

from importlib import import_module

AREAS = ("claims", "governance", "text", "config", "code", "projection", "flows")

for _area in AREAS:
    import_module(f"attesta.catalog.{_area}")
