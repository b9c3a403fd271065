"""Extraction: a file's bytes and language to its facts (`sextant.schemas.EXTRACTION`)."""

from __future__ import annotations

VERSION = "3"


def extract(language: str, data: bytes) -> dict:
    """Facts of one file. A language without an extractor has its file symbol alone."""
    from sextant.extract import clike, markdown, python, shell
    from sextant.extract.facts import Facts

    readers = {"python": python.extract, "markdown": markdown.extract, "c": clike.c, "rust": clike.rust, "bash": shell.bash, "nix": shell.nix}
    if language in readers:
        return readers[language](data)
    facts = Facts()
    facts.symbol("", "", "file", 1, max(1, data.count(b"\n")))
    return facts.done()
