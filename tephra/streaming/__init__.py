"""Incremental forms: mappings and fits arrive in batches and are ranked or summed as they come."""

from .incremental import append_batches, running_fits  # noqa: F401
