"""Personal data in texts: labelers vote on candidate spans, EM weighs them, a classifier decides.

A worker finds candidate spans of four kinds (e-mail and IP addresses, card and phone
numbers): the base spans of strict patterns, and loose ones that patterns for masked,
grouped or national writings find outside of them. Six labelers, of patterns, gazetteers
and context, vote for, against or not at all. All candidates are counted by kind and votes
(at most 4 x 729 counts), and expectation-maximisation estimates from the counts how far
each labeler is to be believed. Its posteriors, summed by kind and features of the span (at
most 4 x 4,096 sums), train a logistic classifier per kind. Base spans always stay; a loose
one is added where the classifier gives it ``THRESHOLD``.

Nothing is sampled and no text is shuffled: one scan writes the candidates of each row, and
all else reads these. Patterns take time linear in the text, also on endless runs of digits
or dots. Places are code points, ends exclusive.

Defined results: a null or empty text has no spans; repeated rows give a result each, equal
ones; where nothing is found nothing is learned and nothing added; an empty table gives an
empty table; other columns than the two asked for are not looked at.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import cut

KINDS = EMAIL, IP, CARD, PHONE = ("email", "ip", "card", "phone")
LABELERS = ("strict", "form", "gazetteer", "value", "context", "edges")
FEATURES = ("strict", "form", "gazetteer", "value", "words before", "other words before",
            "words after", "separators", "clear before", "clear after", "few digits", "long")
THRESHOLD = 0.9
# Characters before and after a span in which context words count.
CONTEXT = 40
ROUNDS = 60
# Posteriors are summed as whole numbers, so that no order of rows changes a digit.
SCALE = 1_000_000_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# Longest rows of numbers between dots; four of them at a time are what the strict pattern finds.
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

WIDE_DOMAIN = re.compile(r"[\w-]++(?:\.[\w-]++)+")
MASKED_AT = re.compile(r"[\[({<] ?(?:at|At|AT|@) ?[\])}>]")
MASKED_DOMAIN = re.compile(
    r" ?[A-Za-z0-9-]++(?: ?(?:\.|[\[({<] ?(?:dot|Dot|DOT|\.) ?[\])}>]) ?[A-Za-z0-9-]++)+")
MASKED_DOT = ("[.", "(.", "{.")
MASKED_IP = re.compile(r"[0-9]{1,3}(?: ?[\[({]?\.[\])}]? ?[0-9]{1,3}){3}(?![0-9])")
HEX = frozenset("0123456789abcdefABCDEF:.")
CHAIN = re.compile(r"[0-9](?:[ ().\-/ –]{0,2}[0-9])+")

# Endings of addresses, starts of numbers, and words near personal data.
ENDINGS = frozenset(
    "com org net edu gov info biz io eu de fr es it uk nl be at ch pl pt se dk fi no ie us ca au "
    "nz jp kr cn in br mx ru".split())
COUNTRY_CODES = tuple(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 "
    "65 66 81 82 84 86 90 91 92 351 352 353 358 420".split())
NEAR = {
    EMAIL: "mail email e-mail contact write courriel correo kontakt adresse address".split(),
    IP: "ip host server address adresse address: client from".split(),
    CARD: "card credit visa mastercard amex karte carte tarjeta debit payment".split(),
    PHONE: "phone tel tel. telephone call fax mobile cell telefon téléphone teléfono handy".split(),
}
APART = frozenset("version v section token hash id isbn issn order no. nr. § sha key serial".split())
WORDS = re.compile(r"[^\W\d_][\w.-]*:?|§")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _before(text: str, at: int, least: int, fits) -> int:
    """Start of the run of fitting characters that ends at a place."""
    while at > least and fits(text[at - 1]):
        at -= 1
    return at


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the strict patterns: leftmost, non-overlapping per kind, then checked."""
    spans, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = _before(text, at, last, LOCAL.__contains__)
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            spans.append((EMAIL, start, last))
        at = text.find("@", max(at + 1, last))
    for m in DOTTED.finditer(text):
        parts = m.group().split(".")
        start = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                spans.append((IP, start, end))
            start = end + 1
    for m in DIGITS.finditer(text):
        digits = digits_of(m.group()) if m.end() - m.start() <= 37 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append((CARD, *m.span()))
    for m in PLUS.finditer(text):
        if 9 <= len(digits_of(m.group())) <= 15:
            spans.append((PHONE, *m.span()))
    return spans


def loose_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Other writings, outside of the base spans and of each other, the earlier kind first."""
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    found: list[tuple[str, int, int]] = []

    def wide(c: str) -> bool:
        return c.isalnum() or c in "._%+-'"

    last, at = 0, text.find("@")
    while at >= 0:
        start = _before(text, at, last, wide)
        m = WIDE_DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((EMAIL, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    last = 0
    for m in MASKED_AT.finditer(text):
        stop = m.start() - (text[m.start() - 1:m.start()] == " ")
        start = _before(text, stop, last, LOCAL.__contains__)
        rest = MASKED_DOMAIN.match(text, m.end()) if start < stop else None
        if rest:
            found.append((EMAIL, start, rest.end()))
            last = rest.end()
    last, at = 0, text.find(":")
    while at >= 0:
        start, end = _before(text, at, last, HEX.__contains__), at
        while end < len(text) and text[end] in HEX:
            end += 1
        last = end
        groups = text[start:end].rstrip(".:").split(":") if end - start <= 45 else []
        short = groups.count("") == 1 and len(groups) <= 8
        if 3 <= len(groups) <= 8 and (short or len(groups) == 8) and all(
                len(g) <= 4 for g in groups):
            found.append((IP, start, start + len(text[start:end].rstrip(".:"))))
        at = text.find(":", last)
    if any(mark in text for mark in MASKED_DOT):
        found += [(IP, *m.span()) for m in MASKED_IP.finditer(text)]
    for m in CHAIN.finditer(text):
        count = len(digits_of(m.group())) if m.end() - m.start() <= 60 else 0
        start = m.start() - (text[m.start() - 1:m.start()] in ("+", "("))
        if 13 <= count <= 19:
            found.append((CARD, *m.span()))
        elif 7 <= count <= 15:
            found.append((PHONE, start, m.end()))
    kept: list[tuple[str, int, int]] = []
    ends = dict(taken)
    free = sorted(found, key=lambda f: (f[1], KINDS.index(f[0]), -f[2]))
    k, reach = 0, 0
    for kind, start, end in free:
        while k < len(starts) and ends[starts[k]] <= start:
            k += 1
        clear = k == len(starts) or starts[k] >= end
        beside = text[start - 1:start].isalnum() or text[end:end + 1].isalnum()
        if clear and not beside and start >= reach:
            kept.append((kind, start, end))
            reach = end
    return kept


def judged(text: str, kind: str, start: int, end: int, strict: bool) -> tuple[int, int]:
    """The labelers' votes as digits to base 3 (0 against, 1 none, 2 for), and feature bits."""
    span = text[start:end]
    digits = digits_of(span)
    parts = re.findall(r"[0-9]+", span)
    value = 0
    if kind == EMAIL:
        plain = re.sub(r" ?[\[({<] ?(?:dot|\.) ?[\])}>] ?", ".", span, flags=re.IGNORECASE)
        local = re.split(r" ?[\[({<] ?(?:at|@) ?[\])}>] ?|@", plain, flags=re.IGNORECASE)[0]
        domain = plain[len(local):].lstrip("[({< @aAtT])}>").split(".")
        ending = domain[-1].lower()
        form = not local.startswith(".") and not local.endswith(".") and all(
            d and d[0] != "-" and d[-1] != "-" for d in domain) and ending.isalpha()
        gazetteer = 1 if ending in ENDINGS else -1
    elif kind == IP:
        form = ":" in span or all(p == "0" or p[0] != "0" for p in parts)
        private = digits.startswith(("10", "127", "192168", "169254", "0")) or ":" in span
        gazetteer = 0 if private else 1
        value = 1 if ":" in span or all(len(p) <= 3 and int(p) <= 255 for p in parts) else -1
    elif kind == CARD:
        sizes = [len(p) for p in parts]
        form = len(sizes) == 1 or sizes in ([4, 4, 4, 4], [4, 6, 5], [4, 4, 4, 4, 3], [4, 6, 4])
        start_ok = digits[0] in "456" or digits[:2] in ("34", "37", "35", "36", "38") \
            or "2221" <= digits[:4] <= "2720"
        gazetteer = 1 if start_ok else -1
        value = 1 if luhn(digits) else -1
    else:
        form = span[0] in "+(0" and len(parts) > 1 and all(len(p) <= 5 for p in parts)
        plus = digits if span[0] == "+" else digits[2:] if digits.startswith("00") else ""
        gazetteer = 0 if not plus else 1 if plus.startswith(COUNTRY_CODES) else -1
        dates = len(parts) == 3 and sorted(map(len, parts)) == [2, 2, 4]
        value = -1 if dates or not 9 <= len(digits) <= 15 else 1
    before = WORDS.findall(text[max(0, start - CONTEXT):start].lower())[-4:]
    after = WORDS.findall(text[end:end + CONTEXT].lower())[:3]
    near = {w.rstrip(":") for w in before} & set(NEAR[kind])
    other = any(w.rstrip(":") in APART for w in before[-2:])
    behind = {w.rstrip(":.") for w in after} & set(NEAR[kind])
    clear_before = start == 0 or text[start - 1].isspace() or text[start - 1] in "(<[,;:"
    clear_after = end == len(text) or text[end].isspace() or text[end] in ")>],;:.!?"
    context = 1 if near and not other else -1 if other and not near else 0
    votes = (int(strict), 1 if form else -1, gazetteer, value, context,
             1 if clear_before and clear_after else -1)
    flags = (strict, form, gazetteer == 1, value == 1, bool(near), other, bool(behind),
             len(parts) > 1, clear_before, clear_after, len(set(digits)) <= 2, len(span) > 24)
    return (sum((v + 1) * 3 ** k for k, v in enumerate(votes)),
            sum(1 << k for k, f in enumerate(flags) if f))


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
                   ("base", pa.bool_()), ("votes", pa.int32()), ("features", pa.int32())])
SCANNED = ("key long, found array<struct<kind:int,start:long,end:long,base:boolean,votes:int,"
           "features:int>>")


def scan(text: str) -> list[dict]:
    base = base_spans(text)
    spans = [(*s, True) for s in base] + [(*s, False) for s in loose_spans(text, base)]
    out = []
    for kind, start, end, strict in sorted(spans, key=lambda s: (KINDS.index(s[0]), *s[1:3])):
        votes, features = judged(text, kind, start, end, strict)
        out.append({"kind": KINDS.index(kind), "start": start, "end": end, "base": strict,
                    "votes": votes, "features": features})
    return out


def candidates(docs: DataFrame, key: Column | str = "doc_id", text: Column | str = "text"
               ) -> DataFrame:
    """Each row's key and its candidate spans with votes and features; texts stay behind."""
    def run(batches):
        for batch in batches:
            found = [scan(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(_SPAN))], ["key", "found"])

    column = F.col(key) if isinstance(key, str) else key
    value = F.col(text) if isinstance(text, str) else text
    return docs.select(column.cast("long").alias("key"), value.alias("text")).mapInArrow(
        run, SCANNED)


def vote_digits(codes: np.ndarray) -> np.ndarray:
    """One row per code, one column per labeler: 0 against, 1 none, 2 for."""
    return codes[:, None] // 3 ** np.arange(len(LABELERS)) % 3


def reliabilities(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM over the vote counts of one kind: posterior per code, and the vote tables.

    ``tables[c, l, v]`` is the chance of vote v by labeler l on a span of class c. It starts
    from the majority and smooths each table by one vote, so an unseen vote stays possible.
    """
    votes = vote_digits(codes)
    belief = 1 / (1 + np.exp(-(votes - 1).sum(1)))
    for _ in range(ROUNDS):
        weights = np.stack([counts * (1 - belief), counts * belief])
        prior = (weights.sum(1) + 1) / (weights.sum() + 2)
        tables = np.stack([[
            (np.bincount(votes[:, k], w, 3) + 1) / (w.sum() + 3) for k in range(len(LABELERS))]
            for w in weights])
        logs = np.log(prior)[:, None] + sum(
            np.log(tables[:, k][:, votes[:, k]]) for k in range(len(LABELERS)))
        belief = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    return belief, tables


def train(patterns: np.ndarray, counts: np.ndarray, beliefs: np.ndarray, ridge: float = 1.0
          ) -> np.ndarray:
    """Weights of a logistic classifier on feature bits, the last one the constant (Newton)."""
    x = np.concatenate([patterns[:, None] >> np.arange(len(FEATURES)) & 1,
                        np.ones((len(patterns), 1), int)], 1).astype(float)
    weights = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (counts * (beliefs - p)) - ridge * weights
        curve = (x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(weights))
        weights += np.linalg.solve(curve, slope)
    return weights


def learn(found: DataFrame) -> np.ndarray:
    """The classifiers' weights, a row per kind, from all candidates' votes and features."""
    spans = found.select(F.inline("found"))
    beliefs = []
    # At most 4 x 3^6 rows.
    counted = spans.groupBy("kind", "votes").count().orderBy("kind", "votes").collect()
    for kind in range(len(KINDS)):
        rows = [r for r in counted if r.kind == kind]
        if rows:
            codes, counts = (np.array([r[k] for r in rows]) for k in (1, 2))
            belief, _ = reliabilities(codes, counts)
            beliefs += [(kind, int(c), int(round(b * SCALE)))
                        for c, b in zip(codes, belief, strict=True)]
    weights = np.zeros((len(KINDS), len(FEATURES) + 1))
    if not beliefs:
        return weights
    table = found.sparkSession.createDataFrame(beliefs, "kind int, votes int, belief long")
    # At most 4 x 2^12 rows.
    summed = spans.join(F.broadcast(table), ["kind", "votes"]).groupBy("kind", "features").agg(
        F.count(F.lit(1)).alias("n"), F.sum("belief").alias("belief")).orderBy(
        "kind", "features").collect()
    for kind in range(len(KINDS)):
        rows = [r for r in summed if r.kind == kind]
        if rows:
            patterns, counts, total = (np.array([r[k] for r in rows]) for k in (1, 2, 3))
            weights[kind] = train(patterns, counts, total / counts / SCALE)
    return weights


def score(span: Column, weights: np.ndarray) -> Column:
    """The classifier's probability for a candidate, as an expression of its bits."""
    def linear(row: np.ndarray) -> Column:
        total = F.lit(float(row[-1]))
        for k in range(len(FEATURES)):
            bit = F.shiftright(span["features"], k).bitwiseAND(F.lit(1))
            total = total + bit * F.lit(float(row[k]))
        return total

    value = linear(weights[0])
    for kind in range(1, len(KINDS)):
        value = F.when(span["kind"] == kind, linear(weights[kind])).otherwise(value)
    return 1 / (1 + F.exp(-value))


def personal_spans(docs: DataFrame, key: Column | str = "doc_id", text: Column | str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """Per row its key and ``spans`` (kind, start, end, base, score), by kind and start."""
    found = cut(candidates(docs, key, text), "personal")
    weights = learn(found)
    names = F.array(*map(F.lit, KINDS))
    spans = F.transform("found", lambda s: F.struct(
        F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        s["base"].alias("base"), score(s, weights).alias("score")))
    return found.select("key", F.filter(
        spans, lambda s: s["base"] | (s["score"] >= threshold)).alias("spans"))
