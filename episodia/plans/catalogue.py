"""All registered queries of the library itself, by name, and their DuckDB equivalents."""

from __future__ import annotations

from episodia.plans import batches, evaluation, files, keys, memories, metadata, pose, stats, trajectory, transforms, vectors

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (trajectory, stats, vectors, keys, evaluation, metadata, pose, transforms, batches, memories, files):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
