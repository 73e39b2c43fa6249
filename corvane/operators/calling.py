"""Model calls from tasks: a shared rate budget, bounded concurrency, retries, and a ledger of what was answered."""

from __future__ import annotations

import hashlib
import inspect
import json
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from corvane.session import ship
from corvane.sources.schemas import BACKOFF_CAP, FIRST_BACKOFF, MAX_TOKENS, RETRIES, TEMPERATURE

#: A scorer takes (system prompt, user prompt, model), and ``temperature`` and ``max_tokens`` if it has such parameters;
#: it returns the raw response and three token counts, or only the response.
Scorer = Callable[..., "str | tuple[str, int | None, int | None, int | None]"]

CALLED = "transcript_id long, dimension string, batch_no int, raw string, prompt_tokens long, completion_tokens long, total_tokens long, error string, latency double"
NO_QUESTIONS, NOT_CONFIGURED = "No Q&A section found", "LLM not configured"
#: A token is taken to be so many characters at least.
TOKEN_CHARS = 3


def estimate(*texts: str) -> int:
    return sum(-(-len(t) // TOKEN_CHARS) for t in texts)


@dataclass(frozen=True)
class Request:
    """All that a response depends on."""

    system: str
    user: str
    model: str
    temperature: float = TEMPERATURE
    max_tokens: int = MAX_TOKENS

    @property
    def key(self) -> str:
        return hashlib.sha256(json.dumps([self.system, self.user, self.model, self.temperature, self.max_tokens]).encode()).hexdigest()

    @property
    def tokens(self) -> int:
        """At most what the request and its answer count for."""
        return estimate(self.system, self.user) + self.max_tokens

    def send(self, scorer: Scorer):
        own = inspect.signature(scorer).parameters
        every = any(p.kind is p.VAR_KEYWORD for p in own.values())
        return scorer(self.system, self.user, self.model, **{k: getattr(self, k) for k in ("temperature", "max_tokens") if every or k in own})


@dataclass(frozen=True)
class Limits:
    """How fast a job may call: ``tokens`` in any ``seconds`` (None: no limit), over ``parallel`` tasks at most with ``concurrency`` calls at once in each.

    The budget is dealt to the tasks in equal shares, which each keeps in any
    stretch of that length, so together they keep it whichever of them run.  There
    are no more tasks than shares that hold the largest request.
    """

    tokens: int | None = None
    seconds: float = 60.0
    parallel: int = 8
    concurrency: int = 1

    def tasks(self, largest: int) -> int:
        return self.parallel if self.tokens is None else max(1, min(self.parallel, self.tokens // max(1, largest)))


@dataclass
class Window:
    """What a task sent in the last ``seconds``: a request waits until it fits into ``budget`` beside that."""

    budget: int | None
    seconds: float = 60.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    sent: deque = field(default_factory=deque)
    held: int = 0
    lock: threading.Lock = field(default_factory=threading.Lock)

    def take(self, tokens: int) -> None:
        if self.budget is None:
            return
        with self.lock:  # who waits first goes first
            while True:
                now = self.clock()
                while self.sent and self.sent[0][0] + self.seconds <= now:
                    self.held -= self.sent.popleft()[1]
                if self.held + tokens <= self.budget:
                    break
                self.sleep(max(self.sent[0][0] + self.seconds - now, 0.001))
            self.sent.append((now, tokens))
            self.held += tokens

    def fill(self) -> None:
        """Count the whole budget as sent just now: what an earlier attempt of this task sent is not known, or the service says that it is too much."""
        if self.budget is not None:
            with self.lock:
                self.sent.append((self.clock(), self.budget))
                self.held += self.budget


class LedgerError(Exception):
    """The ledger cannot be read or written: the task fails, as its answers would not be kept."""


class Ledger:
    """Responses in a shared folder, a small file for each, named by the request; read before a call, written as soon as it returns.

    A task that is run again, or a run that is resumed, repeats only calls that
    were under way.  ``folder`` is a path or URI that every executor reaches.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def _at(self, key: str) -> tuple[pafs.FileSystem, str]:
        local = self.folder.removeprefix("file://").removeprefix("file:") if self.folder.startswith("file:") else self.folder
        files, path = pafs.FileSystem.from_uri(local)
        return files, f"{path.rstrip('/')}/{key[:2]}/{key}.json"

    def get(self, key: str) -> list | None:
        files, path = self._at(key)
        try:
            with files.open_input_stream(path) as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None
        except OSError as error:
            raise LedgerError(path) from error

    def put(self, key: str, answer: list) -> None:
        files, path = self._at(key)
        part = f"{path}.{uuid.uuid4().hex}"
        try:
            files.create_dir(path.rpartition("/")[0], recursive=True)
            with files.open_output_stream(part) as f:
                f.write(json.dumps(answer).encode())
            files.move(part, path)  # whole or not there
        except OSError as error:
            raise LedgerError(path) from error


def limited(error: Exception) -> bool:
    return any(mark in str(error) for mark in ("413", "rate_limit", "429"))


def with_retry(call: Callable[[], object], *, sleep: Callable[[float], None] = time.sleep, on_limit: Callable[[], None] = lambda: None):
    """Up to five attempts with doubling pauses, only for errors that look like a rate limit."""
    pause = FIRST_BACKOFF
    for attempt in range(RETRIES):
        try:
            return call()
        except Exception as error:
            if not limited(error) or attempt == RETRIES - 1:
                raise
            on_limit()
            sleep(pause)
            pause = min(2 * pause, BACKOFF_CAP)


def answer(request: Request, scorer: Scorer, window: Window, ledger: Ledger | None) -> tuple[list, float]:
    """``raw, prompt_tokens, completion_tokens, total_tokens`` of a request, and the call's seconds, from the ledger where it has them."""
    if ledger and (known := ledger.get(request.key)) is not None:
        return known[:4], known[4]
    if window.budget is not None and request.tokens > window.budget:
        raise ValueError(f"The request counts {request.tokens} tokens, over the budget of {window.budget}")

    def call():
        window.take(request.tokens)
        began = time.time()
        got = request.send(scorer)
        return [*(got if isinstance(got, tuple) else (got, None, None, None))], time.time() - began

    got, took = with_retry(call, on_limit=window.fill)
    if ledger:
        ledger.put(request.key, [*got, took])
    return got, took


def call_model(
    calls: DataFrame, scorers: Mapping[str, Scorer] | Scorer | None, system: Callable[[str], str], model: str = "offline", *,
    temperature: float = TEMPERATURE, max_tokens: int = MAX_TOKENS, limits: Limits | None = None, ledger: Ledger | None = None,
) -> DataFrame:
    """The responses to ``calls``; what brings none is a row with ``error`` rather than a failed job.

    That is a failed or exhausted call, a row without a prompt, which makes no
    call, and every row where no scorer is configured (``None``, or a mapping
    without the dimension).  ``latency`` is null where no call was made.
    """
    calls = calls.select("transcript_id", "dimension", "batch_no", "prompt")
    budget, seconds, concurrency = None, 60.0, 1
    if limits:
        sizes = calls.groupBy("dimension").agg(F.max(F.length("prompt")).alias("n")).collect()  # a row for each dimension
        largest = max((estimate(system(r["dimension"])) + (r["n"] or 0) // TOKEN_CHARS + 1 for r in sizes), default=0) + max_tokens
        tasks, concurrency = limits.tasks(largest), limits.concurrency
        calls = calls.repartition(tasks)
        budget, seconds = limits.tokens and limits.tokens // tasks, limits.seconds

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        window = Window(budget, seconds)
        if TaskContext.get().attemptNumber():
            window.fill()

        def one(r) -> tuple:
            scorer = scorers if scorers is None or callable(scorers) else scorers.get(r.dimension)
            got, took, error = (None,) * 4, None, None
            if r.prompt is None:
                error = NO_QUESTIONS
            elif scorer is None:
                error = NOT_CONFIGURED
            else:
                began = time.time()
                try:
                    got, took = answer(Request(system(r.dimension), r.prompt, model, temperature, max_tokens), scorer, window, ledger)
                except LedgerError:
                    raise
                except Exception as e:  # the error is the result
                    error, took = str(e), time.time() - began
            return r.transcript_id, r.dimension, r.batch_no, *got, error, took

        with ThreadPoolExecutor(concurrency) as pool:
            for frame in frames:
                yield pd.DataFrame(list(pool.map(one, frame.itertuples(index=False))), columns=[c.split()[0] for c in CALLED.split(", ")])

    ship(calls.sparkSession)
    return calls.mapInPandas(run, CALLED)
