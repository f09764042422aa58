"""Runs of repeated words: Lyndon arrays by suffix grouping, roots extended into runs.

A run is a longest stretch of words with a smallest period q. In one of the two orders of
the words (one the reverse of the other) every run holds a Lyndon word of length q, its
root, and that root is the longest Lyndon word that starts where it starts. The first phase
of suffix sorting by groups gives the longest Lyndon word of every place: suffixes with one
first word form a group, groups are taken from the highest down, and a suffix that stands
before members of the group taken moves to a group of its own just above its old one. Each
root is then extended to both sides as far as words a period apart agree.

Words that cannot belong to a run of the wanted exponent are set apart first: every word of
such a run is in it at least ``floor(exponent)`` times. What is left between them falls into
stretches that are searched by themselves. This only spares work; no run is lost.

The unit of work is one text in one worker; nothing is shuffled. Defined results: a null,
empty or blank text has no words and no runs; repeated rows give a result each; an empty
table gives an empty table; columns other than the two asked for are not looked at.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
# Rounds in which rare words are set apart; more would spare work, never change a result.
ROUNDS = 8
# Characters of result that a worker gives back in one batch.
BATCH_CHARS = 1 << 23

SCHEMA = ("key long, n_words long, runs array<struct<start:long,length:long,period:long>>, "
          "collapsed string")
_RUN = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])


def lyndon_lengths(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place, by grouping suffixes."""
    n, count = len(ranks), max(ranks, default=-1) + 1
    members: list[list[int]] = [[] for _ in range(count)]
    for i, rank in enumerate(ranks):
        members[rank].append(i)
    group = list(ranks)
    lower, upper = list(range(-1, count - 1)), list(range(1, count + 1))
    # Places not taken yet, as a list linked both ways; the last slots stand for the ends.
    left, right = list(range(-1, n)), list(range(1, n + 2))
    lengths = [0] * n
    now = count - 1
    while now >= 0:
        heads: dict[int, int] = {}
        for i in members[now]:
            if group[i] == now:
                before, after = left[i], right[i]
                lengths[i] = after - i
                right[before], left[after] = after, before
                heads[before] = heads.get(before, 0) + 1
        members[now] = []
        heads.pop(-1, None)
        moved: dict[tuple[int, int], list[int]] = {}
        for place, followers in heads.items():
            moved.setdefault((followers, group[place]), []).append(place)
        # More followers rank higher, and each new group goes just above the old one.
        for followers, old in sorted(moved, reverse=True):
            places, new, above = moved[followers, old], len(members), upper[old]
            members.append(places)
            lower.append(old)
            upper.append(above)
            upper[old] = new
            if above < len(lower) - 1:
                lower[above] = new
            for place in places:
                group[place] = new
        now = lower[now]
    return lengths


def common(words: list[int], a: int, b: int) -> int:
    """Length of the longest common extension of two places, a before b."""
    n, done, step = len(words), 0, 4
    while b + done < n:
        step = min(step, n - b - done)
        if words[a + done:a + done + step] == words[b + done:b + done + step]:
            done += step
            step *= 2
        elif step == 1:
            break
        else:
            step = max(1, step // 8)
    return done


def runs_between(words: list[int], least_length: int, least_exponent: float
                 ) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of ranks; 0 stands between stretches and in no run."""
    n, top = len(words), max(words, default=0) + 1
    found, back = set(), words[::-1]
    for order in (words, [top - w if w else 0 for w in words]):
        lengths = lyndon_lengths(order)
        last: dict[int, int] = {}
        for i, period in enumerate(lengths):
            after = i + period
            if after >= n or last.get(period, 0) >= after:
                continue
            # Three periods hold two roots side by side.
            if least_exponent >= 3 and lengths[after] != period:
                continue
            end = after + common(words, i, after)
            start = i - common(back, n - after, n - i)
            if end - start >= 2 * period:
                last[period] = end
                if (end - start >= max(least_length, least_exponent * period)
                        and 0 not in words[start:start + period]):
                    found.add((start, end - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def frequent_stretches(ids: np.ndarray, least_count: int, least_length: int) -> np.ndarray:
    """Places in stretches whose words each come ``least_count`` times in their stretch."""
    places = np.flatnonzero((np.bincount(ids) >= least_count)[ids])
    for _ in range(ROUNDS):
        if not len(places):
            break
        stretch = np.cumsum(np.diff(places, prepend=places[0] - 1) != 1)
        long = np.bincount(stretch)[stretch] >= least_length
        pairs = stretch * (int(ids.max()) + 1) + ids[places]
        _, at, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        keep = long & (counts[at] >= least_count)
        if keep.all():
            break
        places = places[keep]
    return places


def find_runs(words: list, least_length: int = LEAST_LENGTH,
              least_exponent: float = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a list of words, by start and then period."""
    if least_exponent < 2:
        raise ValueError("a run has at least two periods")
    if len(words) < least_length:
        return []
    numbers: dict = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    places = frequent_stretches(ids, int(least_exponent), least_length)
    if not len(places):
        return []
    gaps = np.flatnonzero(np.diff(places) != 1) + 1
    _, ranks = np.unique(ids[places], return_inverse=True)
    packed = np.insert(ranks + 1, gaps, 0).tolist()
    origin = np.insert(places, gaps, -1).tolist()
    return [(origin[s], length, period)
            for s, length, period in runs_between(packed, least_length, least_exponent)]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, each run cut to its first period."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept)])


def periodic_runs(docs: DataFrame, key: Column | str = "doc_id", text: Column | str = "text",
                  least_length: int = LEAST_LENGTH, least_exponent: float = LEAST_EXPONENT
                  ) -> DataFrame:
    """Per row its key as ``key``, ``n_words``, ``runs`` and the ``collapsed`` text."""
    def search(batches):
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            rows: list[list] = [[], [], []]
            first, size = 0, 0
            for k in range(len(texts)):
                # bytes.split() knows the six ASCII characters of white space and no others.
                words = (texts[k].as_py() or "").encode().split()
                runs = find_runs(words, least_length, least_exponent)
                rows[0].append(len(words))
                rows[1].append([dict(zip(("start", "length", "period"), r, strict=True))
                                for r in runs])
                rows[2].append(collapse(words, runs).decode())
                size += len(rows[2][-1])
                if size >= BATCH_CHARS or k == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays(
                        [keys.slice(first, k + 1 - first), pa.array(rows[0], pa.int64()),
                         pa.array(rows[1], pa.list_(_RUN)), pa.array(rows[2], pa.string())],
                        ["key", "n_words", "runs", "collapsed"])
                    rows, first, size = [[], [], []], k + 1, 0

    column = F.col(key) if isinstance(key, str) else key
    value = F.col(text) if isinstance(text, str) else text
    return docs.select(column.cast("long").alias("key"), value.alias("text")).mapInArrow(
        search, SCHEMA)
