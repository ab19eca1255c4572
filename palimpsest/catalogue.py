"""All queries of the library by name, with their SQL where SQL can express them."""

from __future__ import annotations

from .plans import engines, files, pages, readers, runs, texts

QUERIES = texts.QUERIES | engines.QUERIES | files.QUERIES | pages.QUERIES | readers.QUERIES | runs.QUERIES
ORACLES = texts.ORACLES | engines.ORACLES | files.ORACLES | pages.ORACLES | readers.ORACLES | runs.ORACLES
