"""Language by string kernels: blended-spectrum presence, Nyström landmarks, kernel ridge.

Two texts are as alike as the cosine of their sets of 1- to 4-grams of letters. The sets
are hashed to ``DIMENSIONS`` places, so kernels with the landmarks are one matrix product a
batch. Landmarks map a text to features by the inverse root of their own kernel matrix, and
a ridge regression per language, against the rest, scores the features.

The model is fitted on a bounded sample of labelled rows: about ``SAMPLE_PER_LANGUAGE`` rows
of each language, chosen by hash, or all if there are fewer. Scoring reads every text whole,
in place, without a shuffle.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every
text if no row can be learnt from; the best of equal scores is the first language in order;
repeated rows get the same result; empty tables give empty tables.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONGEST = 4
DIMENSIONS = 1 << 14
SAMPLE_PER_LANGUAGE = 600
LANDMARKS = 128
RIDGE = 1.0
BATCH = 128
UNKNOWN = "und"
# A model holds a column of weights per language; tables with more are refused.
MOST_LANGUAGES = 1000
MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter; built once per worker."""
    if not _LETTERS:
        table = np.zeros(0x110000, bool)
        table[:0xD800] = [chr(c).isalpha() for c in range(0xD800)]
        table[0xE000:] = [chr(c).isalpha() for c in range(0xE000, 0x110000)]
        _LETTERS.append(table)
    return _LETTERS[0]


def grams(text: str | None) -> np.ndarray:
    """Places of the text's n-grams, possibly repeated; empty if it has no letter.

    Runs of other characters than letters are one space.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[points]
    if not letter.any():
        return np.zeros(0, np.uint32)
    points = np.where(letter, points, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points = points[keep]
    places = []
    for n in range(1, LONGEST + 1):
        if len(points) < n:
            break
        count = len(points) - n + 1
        mixed = np.full(count, n * 0x51ED27, np.uint32)
        for k in range(n):
            mixed += points[k:k + count] * MIX[k]
            mixed ^= mixed >> np.uint32(13)
            mixed *= np.uint32(0x2C1B3C6D)
        places.append(mixed >> np.uint32(32 - 14))
    return np.concatenate(places)


def presence(texts: list[str | None]) -> np.ndarray:
    """One row of zeros and ones per text."""
    rows = np.zeros((len(texts), DIMENSIONS), np.float32)
    for row, text in zip(rows, texts, strict=True):
        row[grams(text)] = 1
    return rows


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    norms: np.ndarray
    weights: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        norms = np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))
        return (rows @ self.landmarks.T) / (norms * self.norms) @ self.weights


def fit(rows: np.ndarray, langs: list[str], landmarks: int = LANDMARKS,
        ridge: float = RIDGE) -> Model | None:
    """Fit on presence rows; landmarks come from all languages in turn."""
    names = sorted(set(langs))
    if not names:
        return None
    turn, seen = [], dict.fromkeys(names, 0)
    for i, lang in enumerate(langs):
        turn.append((seen[lang], lang, i))
        seen[lang] += 1
    chosen = rows[[i for _, _, i in sorted(turn)[:landmarks]]]
    norms = np.sqrt(chosen.sum(1))
    own = (chosen @ chosen.T) / np.outer(norms, norms)
    values, vectors = np.linalg.eigh(own.astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    kernel = (rows @ chosen.T) / np.outer(np.sqrt(rows.sum(1)), norms)
    features = kernel @ root
    wanted = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    solved = np.linalg.solve(
        features.T @ features + ridge * np.eye(len(chosen)), features.T @ wanted)
    return Model(names, chosen, norms, (root @ solved).astype(np.float32))


def sample(docs: DataFrame, usable: Column, per_language: int) -> DataFrame:
    """About ``per_language`` usable rows of each language, by hash. Counts come first, and
    their few shares go into the filter, so no text moves."""
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    shares = F.create_map(*[x for r in counts for x in (
        F.lit(r["lang"]), F.lit(min(1.0, per_language / r["n"])))]) if counts else F.create_map(
        F.lit(""), F.lit(0.0))
    draw = F.xxhash64(F.lit(5), "doc_id", "text").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(
        float(1 << 40))
    return rows.where(draw < F.try_element_at(shares, F.col("lang"))).select(
        "doc_id", "lang", "text")


def learn(docs: DataFrame, usable: Column,
          per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """Fit on a bounded sample; executors send its presence bits, not its texts."""
    def bits(parts):
        for part in parts:
            for k in range(0, part.num_rows, BATCH):
                some = part.slice(k, BATCH)
                rows = presence(some.column("text").to_pylist())
                packed = np.packbits(rows.astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("lang"),
                     pa.array([r.tobytes() for r in packed], pa.binary())],
                    ["doc_id", "lang", "bits"])

    got = sample(docs.select(F.col("doc_id").cast("long"), "lang", "text"), usable,
                 per_language).mapInArrow(bits, "doc_id long, lang string, bits binary").collect()
    got.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["bits"]))
    if not got:
        return None
    rows = np.stack([np.unpackbits(np.frombuffer(r["bits"], np.uint8)) for r in got])
    return fit(rows.astype(np.float32), [r["lang"] for r in got])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; the text alone decides."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType([*docs.select(*kept).schema.fields,
                           T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def score(parts):
        for part in parts:
            for k in range(0, part.num_rows, BATCH):
                some = part.slice(k, BATCH)
                rows = presence(some.column("text").to_pylist())
                known = rows.any(1) & (model is not None)
                if model is None:
                    names, best = np.full(len(rows), UNKNOWN, object), np.zeros(len(rows))
                else:
                    values = model.scores(rows)
                    at = values.argmax(1)
                    names = np.where(known, np.array(model.languages, object)[at], UNKNOWN)
                    best = np.where(
                        known, np.clip((values.max(1).astype(float) + 1) / 2, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array(names, pa.string()), pa.array(best, pa.float64())],
                    [*kept, "lang_pred", "score"])

    return docs.select(*kept).mapInArrow(score, schema)
