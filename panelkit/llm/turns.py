"""Repair of conversations by the cheapest edits, over rows sorted within conversations.

A repaired conversation is empty, or a system row or none and then pairs of user and
assistant. Rows are kept (K), given the fitting role (R), deleted (D), or empty ones are
inserted (I); a dynamic program over four states finds the cheapest edits, and of equally
cheap ones those whose letters sort first. It runs in two streams over conversations:

1. ``backpointers`` takes narrow rows (hashes for texts) from each conversation's last turn
   to its first and carries the four costs to the end across Arrow batches. The best letter
   of each state is two bits, so one byte per row is kept; a giant conversation puts these
   bytes out in chunks, each under the key of its first row.
2. ``repair`` takes the rows with texts from the first turn to the last. A chunk comes just
   before its first row, so a task holds one chunk, and the state, at a time.

A conversation is one sorted stream in one task at any length, with bounded memory. Rows
are ordered by turn, nulls first, and within a turn by hashes of role and text, so
repeated rows stand side by side; their first is the original, the others duplicates.

Defined results: a null role has no initial and can only be given a role; a null text is
blank; rows of null conv_id are one conversation; an empty table gives an empty table;
other columns than the four are not looked at.
"""

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import SPACES, WORD, cut

DELETE, INSERT, KEEP, REROLE = range(4)
LETTERS = "DIKR"
# Costs; a truncated row that stays adds its own.
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 2, 5, 1, 5
# States: nothing yet, after the system row, after user, after assistant.
AFTER_ROLE = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
AFTER_KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
AT_END = (0, 2 * INSERT_COST, INSERT_COST, 0)
LEGAL = ("su", "ua", "au")
ALLOWED, TRUNCATED, DUPLICATE, BLANK = range(4)
# Bytes, one per row, after which a chunk of backpointers is put out.
CHUNK = 1 << 20
# Repaired rows, and characters of them, in one batch of a worker.
BATCH_ROWS, BATCH_CHARS = 10_000, 1 << 23

KEYS = ["conv", "timed", "at", "h1", "h2"]
TOTALS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
CHUNKS = ("conv string, timed boolean, at long, h1 long, h2 long, pointers binary, "
          + ", ".join(f"{n} long" for n in TOTALS))
AUDITS = ("conv string, " + ", ".join(f"{n} long" for n in TOTALS)
          + ", audit string, repaired_sha256 string")
REPAIRED = "conv string, place long, edit string, role string, text string"


def keyed(rows: DataFrame) -> DataFrame:
    """Rows under the keys that both streams sort by; keys are never null but for ``conv``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return rows.select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").isNotNull().alias("timed"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("at"),
        F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), role, text).alias("h2"),
        role.alias("role"), text.alias("text"))


def with_faults(keys: DataFrame) -> DataFrame:
    """One narrow row per distinct row: its initial, first fault and number of copies.

    The first turn of each role and text is a count joined back, not a window, so a message
    that a conversation repeats without end stays spread.
    """
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    blank = ~F.col("text").rlike(WORD)
    own = F.when(blank, BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(ALLOWED)
    each = cut(
        keys.select(*KEYS, F.substring("role", 1, 1).alias("initial"), own.alias("fault"))
        .groupBy(*KEYS).agg(F.max("initial").alias("initial"), F.max("fault").alias("fault"),
                            F.count(F.lit(1)).alias("copies")), "turn-keys")
    firsts = each.groupBy("conv", "h1", "h2").agg(F.min(F.struct("timed", "at")).alias("first"))
    same = (F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.h1") == F.col("b.h1"))
            & (F.col("a.h2") == F.col("b.h2")))
    again = F.struct("a.timed", "a.at") != F.col("b.first")
    return each.alias("a").join(firsts.alias("b"), same).select(
        *[f"a.{k}" for k in KEYS], "a.initial", "a.copies",
        F.when(again & (F.col("a.fault") != BLANK), DUPLICATE).otherwise(
            F.col("a.fault")).alias("fault"))


def step(costs: tuple, initial: str, fault: int) -> tuple[tuple, int]:
    """Costs to the end before a row, from those after it, and the best letters as one byte."""
    if fault in (BLANK, DUPLICATE):
        # An insert before a deleted row is no better than the same insert after it.
        return tuple(c + DELETE_COST for c in costs), 0
    stays = TRUNCATED_COST if fault == TRUNCATED else 0
    after = AFTER_KEEP.get(initial, (None,) * 4)
    options = []
    for q in range(4):
        kept = None if after[q] is None else costs[after[q]] + stays
        options.append((costs[q] + DELETE_COST, kept, costs[AFTER_ROLE[q]] + REROLE_COST + stays))
    best = [min(c for c in row if c is not None) for row in options]
    for _ in range(3):
        best = [min(best[q], INSERT_COST + best[AFTER_ROLE[q]]) for q in range(4)]
    byte = 0
    for q, (deleted, kept, _) in enumerate(options):
        if deleted == best[q]:
            letter = DELETE
        elif INSERT_COST + best[AFTER_ROLE[q]] == best[q]:
            letter = INSERT
        else:
            letter = KEEP if kept == best[q] else REROLE
        byte |= letter << 2 * q
    return tuple(best), byte


class Backward:
    """One conversation from its last row to its first."""

    def __init__(self, conv):
        self.conv, self.base, self.costs = conv, 0, AT_END
        self.bytes, self.key = bytearray(), None
        self.counts = [0, 0, 0, 0]
        self.illegal, self.next = 0, None
        self.turns, self.low, self.high = 0, None, None

    def add(self, key: tuple, initial: str, fault: int, copies: int, known: dict):
        timed, at = key[0], key[1]
        if timed and at != self.low:
            self.turns, self.low = self.turns + 1, at
            self.high = at if self.high is None else self.high
        self.counts[fault] += 1
        self.counts[fault if fault == BLANK else DUPLICATE] += copies - 1
        if self.next is not None and initial + self.next not in LEGAL:
            self.illegal += 1
        self.illegal += copies - 1
        self.next = initial
        case = (self.costs, initial, fault)
        if case not in known:
            costs, byte = step(*case)
            low = min(costs)
            known[case] = low, tuple(c - low for c in costs), byte
        low, self.costs, byte = known[case]
        self.base += low + DELETE_COST * (copies - 1)
        self.bytes.append(byte)
        self.key = key

    def chunk(self, whole: bool) -> tuple:
        """Backpointers since the last chunk in the order of turns; totals with the last one."""
        pointers, self.bytes = bytes(reversed(self.bytes)), bytearray()
        totals = [-1] * len(TOTALS)
        if whole:
            gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
            totals = [gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[TRUNCATED],
                      self.illegal, self.base + self.costs[0]]
        return (self.conv, *self.key, pointers, *totals)


def backpointers(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunks of best letters per conversation, found from the last row to the first."""
    columns = [c.split()[0] for c in CHUNKS.split(", ")]

    def run(frames):
        open_, known = None, {}
        for frame in frames:
            out = []
            for conv, *key, initial, copies, fault in zip(
                    *(frame[c].tolist() for c in (*KEYS, "initial", "copies", "fault")),
                    strict=True):
                conv = conv if isinstance(conv, str) else None
                if open_ is None or open_.conv != conv:
                    if open_ is not None:
                        out.append(open_.chunk(True))
                    open_ = Backward(conv)
                elif len(open_.bytes) >= chunk:
                    out.append(open_.chunk(False))
                open_.add(tuple(key), initial, fault, copies, known)
            yield pd.DataFrame(out, columns=columns)
        if open_ is not None:
            yield pd.DataFrame([open_.chunk(True)], columns=columns)

    order = ["conv", *(F.desc(k) for k in KEYS[1:])]
    return rows.select(*KEYS, "initial", "copies", "fault").repartition(
        "conv").sortWithinPartitions(*order).mapInPandas(run, CHUNKS)


class Forward:
    """One conversation from its first row to its last, by its backpointers."""

    def __init__(self, conv, totals: list[int]):
        self.conv, self.totals, self.state = conv, totals, 0
        self.pointers, self.next, self.key = b"", 0, None
        self.letters, self.lines = [], 0

    def insert(self) -> tuple[str, str, str]:
        role = ROLE[self.state]
        self.state = AFTER_ROLE[self.state]
        return "I", role, ""

    def edits(self, key: tuple, role: str, text: str):
        """The edits that this row asks for, as (letter, role, text); None for a deleted row."""
        if key == self.key:
            yield "D", None, None
            return
        self.key = key
        byte = self.pointers[self.next]
        self.next += 1
        while (letter := byte >> 2 * self.state & 3) == INSERT:
            yield self.insert()
        if letter == DELETE:
            yield "D", None, None
            return
        if letter == REROLE:
            role, self.state = ROLE[self.state], AFTER_ROLE[self.state]
        else:
            self.state = AFTER_KEEP[role[0]][self.state]
        yield LETTERS[letter], role, text

    def end(self):
        while AT_END[self.state]:
            yield self.insert()


def _forward(rows: DataFrame, pointers: DataFrame, run, schema: str) -> DataFrame:
    """Rows with texts and, before each chunk's first row, the chunk, as one sorted stream."""
    nothing = F.lit(None).cast("string")
    chunks = pointers.select(
        *KEYS, F.lit(0).alias("kind"), nothing.alias("role"), nothing.alias("text"), "pointers",
        *TOTALS)
    texts = rows.select(
        *KEYS, F.lit(1).alias("kind"), "role", "text", F.lit(None).cast("binary").alias("pointers"),
        *[F.lit(-1).cast("long").alias(n) for n in TOTALS])
    return chunks.unionByName(texts).repartition("conv").sortWithinPartitions(
        *KEYS, "kind").mapInPandas(run, schema)


def _walk(frames):
    """(conversation, its next edits or None at its end) over a sorted stream."""
    now = None
    for frame in frames:
        columns = (frame[c].tolist() for c in (*KEYS, "kind", "role", "text", "pointers"))
        totals = zip(*(frame[n].tolist() for n in TOTALS), strict=True)
        for (conv, *key, kind, role, text, pointers), sums in zip(
                zip(*columns, strict=True), totals, strict=True):
            conv = conv if isinstance(conv, str) else None
            if now is None or now.conv != conv:
                if now is not None:
                    yield now, now.end()
                    yield now, None
                now = Forward(conv, list(sums))
            if kind == 0:
                now.pointers, now.next = bytes(pointers), 0
            else:
                yield now, now.edits(tuple(key), role, text)
    if now is not None:
        yield now, now.end()
        yield now, None


def repaired_rows(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The repaired conversations: conv_id, place from 0, edit (K, R or I), role, text."""
    def run(frames):
        names = [c.split()[0] for c in REPAIRED.split(", ")]
        out, size = [], 0
        for now, edits in _walk(frames):
            for letter, role, text in edits or ():
                if role is not None:
                    out.append((now.conv, now.lines, letter, role, text))
                    now.lines, size = now.lines + 1, size + len(text)
            if len(out) >= BATCH_ROWS or size >= BATCH_CHARS:
                yield pd.DataFrame(out, columns=names)
                out, size = [], 0
        yield pd.DataFrame(out, columns=names)

    rows = keyed(conversations)
    pointers = cut(backpointers(with_faults(rows), chunk), "turn-pointers")
    return _forward(rows, pointers, run, REPAIRED).withColumnRenamed("conv", "conv_id").withColumn(
        "conv_id", F.col("conv_id").cast(conversations.schema["conv_id"].dataType))


def audits(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per conversation its faults, cost, letters of edits, and a digest of the repaired lines.

    The digest is taken as the rows come by; only the letters, one per row, are held.
    """
    def run(frames):
        names = [c.split()[0] for c in AUDITS.split(", ")]
        out, digest = [], hashlib.sha256()
        for now, edits in _walk(frames):
            for letter, role, text in edits or ():
                now.letters.append(letter)
                if role is not None:
                    line = f"{role}:{text}"
                    digest.update((("\n" if now.lines else "") + line).encode())
                    now.lines += 1
            if edits is None:
                out.append((now.conv, *now.totals, "".join(now.letters), digest.hexdigest()))
                digest = hashlib.sha256()
            if len(out) >= BATCH_ROWS:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    rows = keyed(conversations)
    pointers = cut(backpointers(with_faults(rows), chunk), "turn-pointers")
    return _forward(rows, pointers, run, AUDITS).withColumnRenamed("conv", "conv_id").withColumn(
        "conv_id", F.col("conv_id").cast(conversations.schema["conv_id"].dataType))
