"""Canonical input frames: real tables (``canonical``) or generated ones (``testdata``)."""

from tillroll.sources.canonical import SCHEMAS, Sources, conform, from_frames, load_canonical
from tillroll.sources.testdata import load_testdata

__all__ = ["SCHEMAS", "Sources", "conform", "from_frames", "load_canonical", "load_testdata"]
