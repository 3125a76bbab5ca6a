"""The seam to a remote model: batched calls on executors, failures kept as data, every batch asked and paid for once."""

from __future__ import annotations

import base64
import copy
import hashlib
import io
import json
import threading
import time
import uuid
import zlib
from abc import ABC, abstractmethod
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .. import fixed
from ..session import discard, materialise, scratch_path

VERDICT = "user_facing boolean, reason string, proposed_key string"
ANSWER = "id string, user_facing boolean, reason string, proposed_key string, translation string, note string, error string, input_tokens long, output_tokens long"


@dataclass(frozen=True)
class Prompt:
    """What every request tells the model besides its texts; bounded, so it travels with the provider."""

    source_language: str = ""
    context: str = ""
    glossary: tuple[str, ...] = ()
    #: By language, (source, approved wording): fixed.EXAMPLES of each at most.
    examples: dict[str, tuple[tuple[str, str], ...]] = field(default_factory=dict)


class Provider(ABC):
    """Pure data in, data out. Must be picklable; it runs inside tasks, a copy of its own for every call."""

    name = "provider"
    prompt = Prompt()
    #: Tokens read and written by the last call; a provider that knows them sets them.
    usage: tuple[int, int] = (0, 0)

    def told(self, prompt: Prompt) -> "Provider":
        """The same provider with other prompt inputs."""
        out = copy.copy(self)
        out.prompt = prompt
        return out

    @abstractmethod
    def classify(self, batch: list[dict]) -> list[dict]:
        """[{id, text, context}] -> [{id, user_facing, reason, proposed_key}]"""

    @abstractmethod
    def translate(self, batch: list[dict], lang: str) -> list[dict]:
        """[{id, text, context}] -> [{id, translation, note}]"""


class RuleProvider(Provider):
    """Deterministic and offline: copy has an upper-case letter; translation is a language mark. Characters stand for tokens."""

    name = "rules-1"

    def _used(self, batch, written):
        self.usage = (sum(len(r["text"]) for r in batch), sum(map(len, written)))

    def classify(self, batch):
        self._used(batch, ["upper-case letter"] * len(batch))
        return [
            {"id": r["id"], "user_facing": any(c.isupper() for c in r["text"]), "reason": "upper-case letter", "proposed_key": None}
            for r in batch
        ]

    def translate(self, batch, lang):
        out = [{"id": r["id"], "translation": f"[{lang}] {r['text']}", "note": None} for r in batch]
        self._used(batch, [a["translation"] for a in out])
        return out


class RetryingProvider(Provider):
    """Transport policy round another provider: a few attempts with doubling delay for passing faults."""

    def __init__(self, inner: Provider, attempts: int = 5, delay: float = 2.0, passing: tuple = (ConnectionError, TimeoutError)):
        self.inner, self.attempts, self.delay, self.passing = inner, attempts, delay, passing
        self.name = inner.name

    def told(self, prompt):
        out = super().told(prompt)
        out.inner = self.inner.told(prompt)
        return out

    def _call(self, fn: str, *args):
        wait, spent = self.delay, (0, 0)
        inner = copy.copy(self.inner)
        for attempt in range(self.attempts):
            inner.usage = (0, 0)
            try:
                return getattr(inner, fn)(*args)
            except self.passing:
                if attempt == self.attempts - 1:
                    raise
                time.sleep(wait)
                wait *= 2
            finally:
                # what a failed attempt has used is paid for as well
                spent = (spent[0] + inner.usage[0], spent[1] + inner.usage[1])
                self.usage = spent

    def classify(self, batch):
        return self._call("classify", batch)

    def translate(self, batch, lang):
        return self._call("translate", batch, lang)


class AnswerLog:
    """Answers of finished batches in the shared folder: a retried task reads them and asks nothing twice.

    A task has a folder (``share``), an attempt a file with a packed line a batch, so files grow with the tasks. A line is flushed when its
    batch is done; on stores that show closed files only, a lost attempt loses the batches of its last file, ROLL at most.
    """

    ROLL = 400

    def __init__(self, folder: str, share: str = "0"):
        self.fs, path = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)
        self.folder, self.lock, self.out, self.lines = f"{path}/{share}", threading.Lock(), None, 0
        self.known: dict[str, tuple[str, int, int]] = {}  # batches of earlier attempts: file, place and length
        for info in self.fs.get_file_info(pafs.FileSelector(self.folder, allow_not_found=True)):
            with self.fs.open_input_stream(info.path) as raw:
                at = 0
                for line in io.BufferedReader(raw):
                    if line.endswith(b"\n"):  # else the attempt was lost while it wrote
                        self.known[line[:64].decode()] = (info.path, at + 64, len(line) - 64)
                    at += len(line)

    @staticmethod
    def name(batch: list[dict]) -> str:
        return hashlib.sha256(chr(0).join(str(r["id"]) for r in batch).encode()).hexdigest()

    def read(self, batch: list[dict]) -> list[dict] | None:
        if not self.known or (place := self.known.get(self.name(batch))) is None:
            return None
        path, at, length = place
        with self.fs.open_input_file(path) as f:
            f.seek(at)
            return json.loads(zlib.decompress(base64.b64decode(f.read(length))))

    def write(self, batch: list[dict], rows: list[dict]) -> None:
        line = self.name(batch).encode() + base64.b64encode(zlib.compress(json.dumps(rows).encode())) + b"\n"
        with self.lock:
            if self.out is None or self.lines >= self.ROLL:
                self.close()
                self.fs.create_dir(self.folder, recursive=True)
                self.out, self.lines = self.fs.open_output_stream(f"{self.folder}/{uuid.uuid4().hex}"), 0
            self.out.write(line)
            self.out.flush()
            self.lines += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def ask_batch(model: Provider | None, call: Callable, batch: list[dict], log: AnswerLog | None) -> list[dict]:
    """Rows of ANSWER of one batch. Its tokens stand in its first row; ids that were not asked for are discarded."""
    known = log.read(batch) if log else None
    if known is not None:
        return known
    own = copy.copy(model)
    if own is not None:
        own.usage = (0, 0)
    expected, out = {r["id"] for r in batch}, []
    try:
        for a in call(own, batch) if own is not None else call(batch):
            if a.get("id") in expected:
                out.append({**a, "error": None})
                expected.discard(a["id"])
    except Exception as e:  # one bad batch must not end the run
        out = [{"id": r["id"], "error": f"{type(e).__name__}: {e}"[: fixed.PREVIEW_API_ERROR]} for r in batch]
    used = own.usage if own is not None else (0, 0)
    if not out and any(used):
        out = [{"id": batch[0]["id"], "error": "no answer"}]
    for i, row in enumerate(out):
        row["input_tokens"], row["output_tokens"] = used if i == 0 else (0, 0)
    # failures are not kept: a retried task asks these again
    if log and not any(r["error"] for r in out):
        log.write(batch, out)
    return out


def ask(requests: DataFrame, call: Callable, size: int = fixed.BATCH_SIZE, concurrency: int | None = None, model: Provider | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per request id that was answered, or with ``error`` when its batch failed.

    ``requests`` has (id, text, context[, lang]). ``call(model, batch)`` asks, or ``call(batch)`` without a model. Ids are in
    order within a task, so a retried task makes the same batches and takes finished ones from the log; the result is written
    before use, and the log goes then. ``carry`` names string columns of the requests that answers have as well. Open requests are ``concurrency`` at most: tasks times threads of each, so few cores do not lower it.
    """
    session = requests.sparkSession
    wanted = concurrency or session.sparkContext.defaultParallelism
    tasks = max(1, min(wanted, session.sparkContext.defaultParallelism))
    threads = max(1, wanted // tasks)
    folder = scratch_path(session, "answer-log")
    names = [c.split()[0] for c in ANSWER.split(", ")]

    def run(frames):
        context = TaskContext.get()
        log = AnswerLog(folder, str(context.partitionId() if context else 0))
        try:
            with ThreadPoolExecutor(threads) as pool:
                for frame in frames:
                    rows = frame.to_dict("records")
                    batches = [rows[i : i + size] for i in range(0, len(rows), size)]
                    out = [row for part in pool.map(lambda b: ask_batch(model, call, b, log), batches) for row in part]
                    if carry:
                        told = {r["id"]: {c: r[c] for c in carry} for r in rows}
                        out = [{**row, **told[row["id"]]} for row in out]
                    yield pd.DataFrame(out, columns=[*names, *carry]).astype(object).where(lambda d: d.notna(), None)
        finally:
            log.close()

    # a fixed number of tasks; adaptive execution leaves it alone
    placed = requests.repartition(tasks, "id").sortWithinPartitions("id")
    answers = materialise(placed.mapInPandas(run, ", ".join([ANSWER, *[f"{c} string" for c in carry]])), "answers", packed=True)
    discard(session, folder)
    return answers


def token_totals(answers: DataFrame) -> DataFrame:
    """(input_tokens, output_tokens) over all batches."""
    return answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("input_tokens", "output_tokens")])


def all_failed(answers: DataFrame) -> DataFrame:
    """Gate: abort only when there was something to ask and every request failed."""
    return answers.agg(
        F.count("*").alias("total"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.min("error").alias("first_error")
    ).withColumn("abort", (F.col("total") > 0) & (F.col("failed") == F.col("total")))
