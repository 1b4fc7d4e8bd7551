"""Conversion of documents as they arrive."""

from .watch import convert_stream, watch  # noqa: F401
