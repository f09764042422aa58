"""Batch calls of a user-supplied function over prompt rows.

The library brings no model client. ``factory`` makes a callable once per worker
task and setting (provider, model, version); the callable takes the two message
texts and returns the reply text. A row whose call raises carries the error and
the other rows go on.

``call_model`` gives the replies as columns. ``keep_replies`` writes them as they come, a
few at a time and under final names, so that a worker that dies loses only those few.
"""

import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Scorer = Callable[[str, str], str]
Factory = Callable[[str, str], Scorer]

# The log's event time, as the workers write it.
STAMP = "%Y%m%d-%H%M%S"
# Finished replies that may be lost with a worker, and seconds that they may wait.
KEEP_EVERY, KEEP_SECONDS = 20, 30.0

ADDED = (
    T.StructField("raw_response", T.StringType()),
    T.StructField("elapsed_sec", T.DoubleType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("error", T.StringType()),
)
ADDED_KINDS = (pa.string(), pa.float64(), pa.string(), pa.string())


class Clients:
    """A task's callables, one per setting; one that cannot be made is tried again next time."""

    def __init__(self, factory: Factory):
        self.factory, self.made = factory, {}

    def of(self, setting: tuple) -> Scorer | Exception:
        if not isinstance(self.made.get(setting), Callable):
            try:
                self.made[setting] = self.factory(*setting)
            except Exception as problem:
                self.made[setting] = problem
        return self.made[setting]

    def ready(self, rows: Iterable[tuple]) -> Iterator[tuple]:
        """(client, system text, user text) of (model, version, system text, user text)."""
        for m, v, system, user in rows:
            yield (None if system is None or user is None else self.of((m, v)), system, user)


def call(row: tuple) -> tuple:
    """Reply, seconds, time (UTC) and error of one call."""
    use, system, user = row
    reply, error, started = None, None, time.perf_counter()
    try:
        if system is None or user is None:
            raise ValueError("prompt could not be filled")
        if isinstance(use, Exception):
            raise use
        reply = use(system, user)
    except Exception as problem:
        error = f"{type(problem).__name__}: {problem}"
    took = round(time.perf_counter() - started, 3)
    return reply, took, time.strftime(STAMP, time.gmtime()), error


def as_they_come(pool: ThreadPoolExecutor, rows: Iterable[tuple], at_once: int
                 ) -> Iterator[tuple[int, tuple]]:
    """(place, answer) of each row as it is finished; at most ``at_once`` calls are open."""
    open_: dict[Future, int] = {}
    for place, row in enumerate(rows):
        if at_once == 1:
            yield place, call(row)
            continue
        if len(open_) == at_once:
            for done in wait(open_, return_when=FIRST_COMPLETED).done:
                yield open_.pop(done), done.result()
        open_[pool.submit(call, row)] = place
    while open_:
        for done in wait(open_, return_when=FIRST_COMPLETED).done:
            yield open_.pop(done), done.result()


def _with_answers(rows: pa.RecordBatch, names: Sequence[str], answers: list[tuple]
                  ) -> pa.RecordBatch:
    added = list(zip(*answers, strict=True)) or [()] * len(ADDED)
    return pa.RecordBatch.from_arrays(
        [*(rows.column(c) for c in names),
         *(pa.array(a, k) for a, k in zip(added, ADDED_KINDS, strict=True))],
        names=[*names, *(f.name for f in ADDED)])


def _texts(rows: pa.RecordBatch, columns: Sequence[str]) -> Iterator[tuple]:
    return zip(*(rows.column(c).to_pylist() for c in columns), strict=True)


def call_model(df: DataFrame, factory: Factory, model: str = "model", version: str = "version",
               system: str = "system_text", user: str = "user_text", tasks: int | None = None,
               key: str = "persona_uuid",
               prepare: Callable[[DataFrame], DataFrame] | None = None,
               at_once: int = 1) -> DataFrame:
    """Add ``raw_response``, ``elapsed_sec``, ``timestamp`` (UTC) and ``error`` to each prompt row.

    The two message columns are consumed. Calls are slow and rows are small, so the
    partitions a query happens to end with are often too few: ``tasks`` spreads the
    rows over that many by key and cell, which also bounds what a lost executor asks
    again. ``prepare`` adds the message columns after that, so texts are not shuffled.
    ``at_once`` calls of a task run side by side; above 1 the callable must allow that.
    Latency is that of the call, without making the callable. Store the result before
    using it twice: reading it again calls the function again.
    """
    if tasks:
        df = df.repartition(tasks, key, model, version)
    if prepare:
        df = prepare(df)
    kept = [f for f in df.schema.fields if f.name not in (system, user)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clients = Clients(factory)
        with ThreadPoolExecutor(at_once) as pool:
            for rows in batches:
                ready = clients.ready(_texts(rows, (model, version, system, user)))
                answers = dict(as_they_come(pool, ready, at_once))
                yield _with_answers(rows, names, [answers[k] for k in range(rows.num_rows)])

    return df.mapInArrow(run, T.StructType([*kept, *ADDED]))


class Journal:
    """Finished replies of one bucket as small files, each complete under its final name.

    A file is written beside its place and then moved there, so a reader never sees half of
    one. ``pyarrow.fs`` reaches local, HDFS, S3, GCS and Azure paths.
    """

    def __init__(self, store: str, bucket: int):
        self.files, root = pafs.FileSystem.from_uri(store)
        self.folder = f"{root}/bucket={bucket}"
        self.writer, self.number = uuid.uuid4().hex, 0

    def done(self, keys: Sequence[str]) -> set[tuple]:
        """Keys that an earlier attempt has kept: one bucket's, bounded by its rows."""
        listed = self.files.get_file_info(pafs.FileSelector(self.folder, allow_not_found=True))
        found: set[tuple] = set()
        for file in listed:
            if file.base_name.endswith(".parquet") and file.base_name[0] not in "._":
                kept = pq.read_table(file.path, columns=list(keys), filesystem=self.files)
                found.update(zip(*(kept.column(k).to_pylist() for k in keys), strict=True))
        return found

    def keep(self, rows: pa.RecordBatch) -> None:
        if not self.number:
            self.files.create_dir(self.folder, recursive=True)
        name = f"{self.writer}-{self.number:06}.parquet"
        with self.files.open_output_stream(f"{self.folder}/_{name}") as out:
            pq.write_table(pa.Table.from_batches([rows]), out)
        self.files.move(f"{self.folder}/_{name}", f"{self.folder}/{name}")
        self.number += 1


def keep_replies(df: DataFrame, factory: Factory, store: str, keys: Sequence[str],
                 model: str = "model", version: str = "version", system: str = "system_text",
                 user: str = "user_text", buckets: int = 8,
                 prepare: Callable[[DataFrame], DataFrame] | None = None, at_once: int = 1,
                 keep_every: int = KEEP_EVERY, keep_seconds: float = KEEP_SECONDS) -> DataFrame:
    """Ask each row and keep its reply in ``store`` before the task ends.

    Rows are dealt to ``buckets`` by a hash of ``keys``, one task each, all in one job. A task
    leaves out what an earlier attempt at its bucket has kept, and keeps its own replies
    ``keep_every`` at a time, or after ``keep_seconds``: a worker that dies repeats at most
    ``keep_every`` calls and those that were open. Two attempts that run side by side can
    both keep a row; ``stored_replies`` counts the first. The result, one row per bucket with
    the rows ``asked`` and ``known`` before, has to be used for anything to be asked.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    dealt = df.withColumn("bucket", slot).repartitionById(buckets, F.col("bucket"))
    if prepare:
        dealt = prepare(dealt)
    kept = [f for f in dealt.schema.fields if f.name not in (system, user, "bucket")]
    names = [f.name for f in kept]
    layout = to_arrow_schema(T.StructType([*kept, *ADDED]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clients, asked, before, since = Clients(factory), {}, {}, time.monotonic()
        # A task has one bucket, or a few where adding the texts moved the rows.
        journals: dict[int, tuple[Journal, set]] = {}
        waiting: dict[int, list] = {}

        def flush():
            nonlocal since
            for bucket, some in waiting.items():
                rows = pa.Table.from_batches(some).combine_chunks().to_batches()[0]
                journals[bucket][0].keep(rows.cast(layout))
            waiting.clear()
            since = time.monotonic()

        def fresh(rows: pa.RecordBatch) -> Iterator[int]:
            slots = rows.column("bucket").to_pylist()
            for k, (bucket, row) in enumerate(zip(slots, _texts(rows, keys), strict=True)):
                if bucket not in journals:
                    journal = Journal(store, bucket)
                    journals[bucket] = journal, journal.done(keys)
                    asked[bucket] = before[bucket] = 0
                if row in journals[bucket][1]:
                    before[bucket] += 1
                else:
                    yield k

        with ThreadPoolExecutor(at_once) as pool:
            for rows in batches:
                rows = rows.take(pa.array(fresh(rows), pa.int64()))
                slots = rows.column("bucket").to_pylist()
                ready = clients.ready(_texts(rows, (model, version, system, user)))
                try:
                    for place, answer in as_they_come(pool, ready, at_once):
                        bucket = slots[place]
                        asked[bucket] += 1
                        waiting.setdefault(bucket, []).append(
                            _with_answers(rows.slice(place, 1), names, [answer]))
                        many = sum(map(len, waiting.values())) >= keep_every
                        if many or time.monotonic() - since > keep_seconds:
                            flush()
                finally:
                    flush()
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array(asked, pa.int32()), "asked": pa.array(asked.values(), pa.int64()),
            "known": pa.array(before.values(), pa.int64())})

    return dealt.mapInArrow(run, "bucket int, asked long, known long")


def smoke_call(df: DataFrame, factory: Factory, **names: str) -> DataFrame:
    """The same call on one row, to look at before a run."""
    return call_model(df.limit(1), factory, **names)
