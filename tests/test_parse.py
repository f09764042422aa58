"""Replies against a brute-force reading of the same rules in plain Python."""

import json
import random
import re

from pyspark.sql import functions as F

from panelkit.fixed_values import REASON_KEYS, VOTE_KEYS
from panelkit.functions.parse import close_object, is_good, parse_replies, split_replies


def closed(text):
    _, brace, rest = text.rpartition("{")
    inner, end, _ = rest.rpartition("}")
    if not end:
        inner = re.sub(r",*\Z", "", re.sub(r"\s*\Z", "", rest))
        inner += '"' * (inner.count('"') % 2)
    return brace + inner + "}" if brace else text


def expected(raw):
    text = re.sub(r"```(?:json)?\s*", "", re.sub(r"(?s)<think>.*?</think>", "", raw))
    first, last = text.find("{"), text.rfind("}")
    tries = [(False, text[first:last + 1])] if -1 < first < last else []
    for salvaged, candidate in [*tries, (True, closed(text))]:
        try:
            found = json.loads(candidate)
        except ValueError:
            continue
        if not isinstance(found, dict):
            break
        pick = [next((found[k] for k in keys if found.get(k)), None)
                for keys in (VOTE_KEYS, REASON_KEYS)]
        return *pick, salvaged
    return None, None, None


SHAPES = [
    '{"vote": "A", "reason": "b"}',
    '```json\n{"vote": "A", "reason": "b"}\n```',
    '<think>{"vote": "no"}\n</think>\n{"vote": "A", "reason": "b"}',
    '<think>a</think>{"vote": "A"<think>b</think>, "reason": "b"}',
    'Sure: {"vote": "A", "reason": "b"} done.',
    '{"vote": "A", "reason": "b", "more": {"x": [1, 2]}}',
    '{"vote": "A", "reason": "b"} {"vote": "C", "reason": "d"}',
    '{"vote": "A"} {"reason": "d"}',
    '{"vote": "A", "reason": "b"},{"vote": "C", "reason": "d"}',
    '{"vote": "A", "reason": "b"}],[{"vote": "C", "reason": "d"}',
    "{'vote': 'A', 'reason': 'b'}",
    '{"vote": "A", "vote": "B", "reason": "b"}',
    '{"party": "A", "이유": "b"}', '{"vote": "", "정당": "A", "rationale": "b"}',
    '{"vote": 0, "party": "0", "reason": "b"}', '{"vote": false, "지지": "A", "설명": "b"}',
    '{"vote": null, "선택": "A", "근거": "b"}', '{"vote": [], "투표": "A", "사유": "b"}',
    '{"vote": {}, "party": "A", "reason": ""}', '{"vote": 0.0, "party": "A", "reason": "b"}',
    "", "no object", "[1, 2]", '"text"', "}{", "{", "}", "{}",
    '{"vote": "A", "reason": "cut in the mid', '{"vote": "A", "reason": "b", ', '{"vote": "A",, ',
    '{"vote": "A", "reason": "b"\u3000\x1c', '{"vote": "A", "reason": {"x": "y"',
    '{"vote": "A", "reason": "tail\\', '{"vote": "A", "reason": "line\nbreak"}',
    '{"vote": "A", "reason": "b",}', '{"vote": "A", "reason": "b"}}', '{"vote": "A" "reason": "b"}',
    '{"vote": "한글", "reason": "\\ud55c\\n\\"q\\""}', '{"vote":"A","reason":"b"}\n```\n```',
]


def check(spark, raws):
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw_response string")
    for r in parse_replies(df).collect():
        vote, reason, salvaged = expected(raws[r.i])
        assert (r.vote, r.reason) == (vote, reason), raws[r.i]
        assert (r.error is None) == bool(vote and reason), raws[r.i]
        assert r.salvaged == bool(salvaged), raws[r.i]


def test_shapes(spark):
    check(spark, SHAPES)


def test_random_texts(spark):
    rng = random.Random(5)
    pieces = ['{', '}', '"', '"vote"', '"reason"', ':', ',', ' ', '\n', '"A"', '"b"', '{"vote": "A", ',
              '"reason": "b"', '```json', '```', '\\', 'x', '\u3000', '<think>', '</think>', '1']
    check(spark, ["".join(rng.choices(pieces, k=rng.randrange(1, 12))) for _ in range(3000)])


def test_every_cut_of_a_reply(spark):
    whole = '```json\n{"vote": "A", "reason": "say \\"yes\\", {now}, \\u00e9"}\n```'
    check(spark, [whole[:i] for i in range(len(whole) + 1)])


def test_close_object(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices('{}", \n\ta\u3000', k=rng.randrange(0, 10))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(close_object("t")).collect()] == [closed(t) for t in texts]


def test_errors_and_split(spark):
    raws = ['{"vote": "A", "reason": "b"}', '{"vote": "A"}', "nothing", None, '{}']
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw_response string")
    good, bad = split_replies(parse_replies(df))
    assert [r.i for r in good.collect()] == [0] and "error" not in good.columns
    assert {r.i: r.error for r in bad.collect()} == {
        1: "missing keys: ['vote']", 2: "no parseable JSON in response: nothing",
        3: "no parseable JSON in response: ", 4: "missing keys: []"}


def test_failed_call_keeps_its_error(spark):
    df = spark.createDataFrame([(None, "Timeout: slow")], "raw_response string, error string")
    assert parse_replies(df).first().error == "Timeout: slow"


def test_control_characters_are_opt_in(spark):
    df = spark.createDataFrame([('{"vote": "A", "reason": "two\nlines"}',)], "raw_response string")
    assert parse_replies(df).first().error is not None
    row = parse_replies(df, control_chars=True).first()
    assert (row.vote, row.reason, row.salvaged) == ("A", "two\nlines", False)


def test_is_good(spark):
    df = spark.createDataFrame([("A", "b"), ("", "b"), (None, "b"), ("A", None)],
                               "vote string, reason string")
    assert [r[0] for r in df.select(is_good()).collect()] == [True, False, False, False]


def test_filters_do_not_copy_the_parser(spark):
    df = spark.createDataFrame([("x",)], "raw_response string").where(F.lit(True))
    plan = split_replies(parse_replies(df))[1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("(?s)<think>") == 1
