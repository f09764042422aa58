"""Personal data: strict spans against the plain patterns, and what votes and EM add."""

import hashlib
import random
import re

import numpy as np

from panelkit.llm import personal, queries
from panelkit.llm.common import cut

SCHEMA = "doc_id long, text string, key long, found string, spans string, base int"

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c.isdigit()]
            doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10))
                       for k, d in enumerate(reversed(digits))]
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
                    or kind == "card" and 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
                    or kind == "phone" and 9 <= len(digits) <= 15):
                out.append((kind, *m.span()))
    return out


def test_strict_spans_are_those_of_the_plain_patterns():
    random_ = random.Random(2)
    pieces = ["a", "b.c", "@", ".", "-", "1", "22", "255", "256", "0", "+", " ", "(", ")", "é", "_",
              "4111111111111111", "4111 1111-1111 1111", "1.2.3.4", "x@y.zz", "+49 30 1234567",
              "٣", "\n", "%"]
    for _ in range(20_000):
        text = "".join(random_.choices(pieces, k=random_.randint(0, 14)))
        got = [s for kind in personal.KINDS
               for s in personal.base_spans(text) if s[0] == kind]
        assert got == plain_spans(text), text


def test_endless_runs_take_linear_work():
    n = 300_000
    for text in ("1" * n, "1." * n, "a@" * n, "a" * n + "@", "+" * n, "+1" + " " * n, ":" * n,
                 "(" * n, "1 " * n, "[at]" * n, "a:" * n):
        personal.scan(text)


def test_em_finds_the_reliable_labelers():
    """Two labelers tell the truth mostly, two vote by chance."""
    random_ = np.random.default_rng(3)
    truth = random_.random(4000) < 0.3
    good = [np.where(random_.random(4000) < 0.9, truth, ~truth) for _ in range(3)]
    noise = [random_.random(4000) < 0.5 for _ in range(3)]
    votes = np.stack([2 * v.astype(int) for v in (*good, *noise)], 1)
    codes, at, counts = np.unique(
        (votes * 3 ** np.arange(6)).sum(1), return_inverse=True, return_counts=True)
    belief, tables = personal.reliabilities(codes, counts)
    assert ((belief[at] > 0.5) == truth).mean() > 0.95
    assert (tables[1, :3, 2] > 0.8).all() and (abs(tables[:, 3:, 2] - 0.5) < 0.1).all()


def test_masked_spans_are_added_and_failing_numbers_are_not(spark):
    rows = []
    for k in range(300):
        rows += [(4 * k, f"please mail ann{k}@site{k % 7}.org now"),
                 (4 * k + 1, f"card 4111 1111 1111 1111 or nothing, call +49 30 123{k:04d}5"),
                 (4 * k + 2, f"order no. {7 * 10 ** 15 + 37 * k} and section 3.1"),
                 (4 * k + 3, "nothing here. 12 of 40 (see 2.3)")]
    rows += [(5000, "mail to bob [at] site [dot] org today"), (5001, "Ärger mit jürgen@site.org"),
             (5002, None), (5003, "")]
    got = {r.key: r.spans for r in personal.personal_spans(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    texts = dict(rows)
    for key, text in texts.items():
        base = [(s.kind, s.start, s.end) for s in got[key] if s.base]
        assert base == plain_spans(text or "")
    added = {k: [texts[k][s.start:s.end] for s in v if not s.base] for k, v in got.items()}
    assert added[5000] == ["bob [at] site [dot] org"]
    decoys = [k for k in texts if k < 5000 and k % 4 >= 2 and not plain_spans(texts[k])]
    assert decoys and not any(added[k] for k in decoys)


def test_hard_rows(spark):
    rows = [(1, None), (1, None), (None, "a@b.cc"), (2, "a@b.cc"), (2, "a@b.cc"), (3, ""),
            (4, "x " * 100_000 + "a@b.cc")]
    docs = cut(spark.createDataFrame([(*r, 5, "f", "s", 1) for r in rows], SCHEMA), "docs")
    got = sorted(((r.key, len(r.spans)) for r in personal.personal_spans(docs).collect()), key=repr)
    assert got == sorted(((k, int(t is not None and "@" in t)) for k, t in rows), key=repr)
    assert personal.personal_spans(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    seen = 0
    for r in queries.op12_personal_data(spark, folder).collect():
        spans = plain_spans(docs[r.doc_id])
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(
            sum(s[0] == k for s in spans) for k in personal.KINDS)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
        seen += len(spans)
    assert seen
