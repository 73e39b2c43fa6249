"""Logging of the command line: everything to a file, what matters to the console."""

from __future__ import annotations

import logging
from pathlib import Path

NAME = "corvane"


def setup(path: str | None = None, name: str = NAME) -> logging.Logger:
    """The logger ``name``: INFO and above on the console, DEBUG and above in the file at ``path``.  Set up once, it stays."""
    logger = logging.getLogger(name)
    logger.setLevel(logging.DEBUG)
    form = logging.Formatter("%(asctime)s %(levelname)-8s %(message)s")
    if not logger.handlers:
        console = logging.StreamHandler()
        console.setLevel(logging.INFO)
        console.setFormatter(form)
        logger.addHandler(console)
    if path and not any(isinstance(h, logging.FileHandler) for h in logger.handlers):
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        file = logging.FileHandler(path, encoding="utf-8")
        file.setLevel(logging.DEBUG)
        file.setFormatter(form)
        logger.addHandler(file)
    return logger
