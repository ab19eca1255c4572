"""Page formats: Markdown and JSON as columns, ALTO and hOCR as trees built per page."""

from __future__ import annotations

from ..errors import ConfigError
from . import pages

FORMATS = {"markdown": pages.markdown, "json": pages.json_page, "alto": pages.alto, "hocr": pages.hocr}
ENDINGS = {"markdown": ".md", "json": ".json", "alto": ".xml", "hocr": ".html"}


def formatter(name: str):
    if name not in FORMATS:
        raise ConfigError(f"unknown output format {name}; known: {', '.join(FORMATS)}")
    return FORMATS[name]
