"""What runs leave behind: events as lines of JSON, index runs with their outcome, timings and memory."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path
from threading import Event, Thread

from pyspark.sql import DataFrame, SparkSession

EVENTS = "timestamp string, pid long, run_id string, event string, details string"


class Journal:
    """Events that are on the disk when ``write`` returns; a build that fails says so itself."""

    def __init__(self, path: str | Path, run_id: str | None = None):
        self.path, self.run_id = Path(path), run_id or f"run-{uuid.uuid4().hex}"
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.out = self.path.open("a", encoding="utf-8", newline="\n")

    def write(self, event: str, **details: object) -> None:
        record = {"timestamp": datetime.now(UTC).isoformat(), "pid": os.getpid(), "run_id": self.run_id, "event": event, "details": json.dumps(details, ensure_ascii=False, sort_keys=True)}
        self.out.write(json.dumps(record, ensure_ascii=False) + "\n")
        self.out.flush()
        os.fsync(self.out.fileno())

    def __enter__(self) -> Journal:
        return self

    def __exit__(self, kind, error, trace) -> None:
        try:
            if error is not None:
                self.write("failed", error_type=kind.__name__, error=str(error)[:2000])
        finally:
            self.out.close()


@contextmanager
def index_run(path: str | Path, index: str, **details: object) -> Iterator[Journal]:
    """The events of one build of an index: that it began, and that it ended or failed, with the seconds."""
    began = time.monotonic()
    with Journal(path, f"index-{index}-{uuid.uuid4().hex}") as journal:
        journal.write("index_started", index=index, **details)
        yield journal
        journal.write("index_finished", index=index, seconds=round(time.monotonic() - began, 3))


def read_journal(spark: SparkSession, path: str | Path) -> DataFrame:
    """The events as a table; a last line that was cut off is left out."""
    return spark.read.schema(EVENTS).option("mode", "DROPMALFORMED").json(f"file://{Path(path).resolve()}").where("event is not null")


def interrupted(events: DataFrame) -> DataFrame:
    """Runs that began and neither ended nor failed."""
    return events.groupBy("run_id").pivot("event", ["index_started", "index_finished", "failed"]).count().where("index_started > 0 and index_finished is null and failed is null").select("run_id")


@dataclass
class Samples:
    """Resident memory of this process, taken again and again, in MB."""

    interval: float = 0.2
    taken: list[float] = field(default_factory=list)

    @staticmethod
    def resident() -> float:
        pages = int(Path("/proc/self/statm").read_text().split()[1])
        return pages * os.sysconf("SC_PAGE_SIZE") / 1e6

    @contextmanager
    def running(self) -> Iterator[Samples]:
        stop = Event()

        def watch() -> None:
            while not stop.is_set():
                self.taken.append(self.resident())
                stop.wait(self.interval)

        thread = Thread(target=watch, daemon=True)
        thread.start()
        try:
            yield self
        finally:
            stop.set()
            thread.join()


def measure(predict: Callable[[list[str]], list], texts: list[str], batches: Iterable[int], repeats: int = 3) -> list[dict]:
    """By batch size and repeat: documents, tokens, seconds and peak memory of a model over the same texts, in the
    form that ``alignment.throughput`` adds up. The first call, which loads the model, isn't counted."""
    predict(texts[:1])
    tokens = sum(len(t.split()) for t in texts)
    out = []
    for batch in batches:
        for repeat in range(repeats):
            with Samples().running() as memory:
                began = time.perf_counter()
                found = [x for a in range(0, len(texts), batch) for x in predict(texts[a : a + batch])]
                seconds = time.perf_counter() - began
            if len(found) != len(texts):
                raise ValueError("the model answered another number of texts")
            out.append({"batch": batch, "repeat": repeat, "documents": len(texts), "tokens": tokens, "seconds": seconds, "peak_mb": max(memory.taken, default=0.0)})
    return out


# batches on their way


def staged(read: Callable[[], list], prepare: Callable, predict: Callable, depth: int = 1) -> Iterator[tuple[list, object]]:
    """(rows, prediction) of the batches that ``read`` gives until one is empty. Beyond a depth of 1 the next ones are
    read and prepared while one is predicted, ``depth`` at most at a time; an error ends it and drops those waiting."""
    if depth < 1:
        raise ValueError("the depth is 1 at least")

    def ready():
        rows = read()
        return (rows, prepare(rows)) if rows else None

    if depth == 1:
        while (item := ready()) is not None:
            yield item[0], predict(item[1])
        return
    from collections import deque
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(1) as pool:
        waiting = deque(pool.submit(ready) for _ in range(depth))
        try:
            while waiting and (item := waiting.popleft().result()) is not None:
                waiting.append(pool.submit(ready))
                yield item[0], predict(item[1])
        finally:
            for x in waiting:
                x.cancel()


def coalesced(batches: Iterable[tuple[list, list]], rows: int) -> Iterator[tuple[list, list]]:
    """The same (rows, results) in batches of just ``rows`` rows but the last; with 0 as they come. A producer's error
    passes through, and what was held for a batch that isn't full is then not given out."""
    if rows < 0:
        raise ValueError("the number of rows isn't negative")
    held: tuple[list, list] = ([], [])
    for own in batches:
        if len(own[0]) != len(own[1]):
            raise ValueError("a batch has as many results as rows")
        if not rows:
            yield own
            continue
        held = (held[0] + own[0], held[1] + own[1])
        while len(held[0]) >= rows:
            yield held[0][:rows], held[1][:rows]
            held = (held[0][rows:], held[1][rows:])
    if held[0]:
        yield held
