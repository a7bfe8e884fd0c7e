"""Readers and writers of the lake, the catalogue and the column graph."""

from columnscout.sources import readers  # noqa: F401  registers the readers
