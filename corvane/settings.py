"""Settings from a TOML file: what the command line would otherwise be told each time."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace
from typing import Any

from corvane.operators.calling import Limits
from corvane.sources.schemas import CHUNK_WORDS, MAX_TOKENS, MIN_WORDS, TEMPERATURE


@dataclass(frozen=True)
class Settings:
    """Places, the model and its limits, and the sizes that change results."""

    store: str | None = None
    log: str | None = None
    scorer: str | None = None
    model: str = "unknown"
    temperature: float = TEMPERATURE
    max_tokens: int = MAX_TOKENS
    tokens_per_minute: int | None = None
    parallel: int = 8
    concurrency: int = 1
    chunk_words: int = CHUNK_WORDS
    min_words: int = MIN_WORDS

    @classmethod
    def load(cls, path: str | None) -> Settings:
        """The file's values over the defaults; a name that is no setting is an error."""
        if not path:
            return cls()
        with open(path, "rb") as f:
            found = tomllib.load(f)
        if unknown := sorted(set(found) - {f.name for f in fields(cls)}):
            raise ValueError(f"{path}: no such settings: {', '.join(unknown)}")
        return cls(**found)

    def over(self, **given: Any) -> Settings:
        """With those of ``given`` that are settings and not None."""
        names = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in given.items() if k in names and v is not None})

    @property
    def limits(self) -> Limits | None:
        """None where nothing is limited: then each task calls one after another."""
        if self.tokens_per_minute is None and self.concurrency == 1:
            return None
        return Limits(self.tokens_per_minute, parallel=self.parallel, concurrency=self.concurrency)

    @property
    def calling(self) -> dict[str, Any]:
        """What the calls of a run are given."""
        return {"model": self.model, "temperature": self.temperature, "max_tokens": self.max_tokens, "limits": self.limits}
