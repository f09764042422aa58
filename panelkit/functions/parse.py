"""Model replies to typed columns, as native expressions.

A reply is stripped of thinking blocks and code fences, its JSON object is read
strictly, and a reply that was cut off is closed and read once more. The answer
and the reason are the first non-empty values among their accepted names.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit import fixed_values as fv
from panelkit.functions.columns import _col, bind, preview

_END = "__end_of_reply"
_FENCE = rf"```(?:json)?[{fv.WHITE_SPACE}]*"


def strip_noise(raw: Column | str) -> Column:
    """Drop ``<think>`` blocks, then code fences and the white space after an opening one."""
    raw = _col(raw)
    # Most replies have neither, and a plain search is much cheaper than a pattern.
    thought = F.regexp_replace(raw, r"(?s)<think>.*?</think>", "")
    return (
        F.when(raw.contains("<think>"), F.regexp_replace(thought, _FENCE, ""))
        .when(raw.contains("```"), F.regexp_replace(raw, _FENCE, ""))
        .otherwise(raw)
    )


def outer_object(text: Column | str) -> Column:
    """From the first opening to the last closing brace; empty when there is no such span."""
    return F.regexp_extract(_col(text), r"(?s)\{.*\}", 0)


def close_object(text: Column | str) -> Column:
    """The last object of a text, closed if it was cut off.

    The span starts at the last opening brace. If a closing brace follows, the
    span ends there. Otherwise trailing space and commas go, an odd number of
    quotes gets one more, and a closing brace is added. A text without an
    opening brace is returned unchanged.
    """
    text = _col(text)
    tail = F.substring_index(text, "{", -1)
    closed = F.concat(F.lit("{"), F.regexp_extract(tail, r"(?s)^.*\}", 0))
    quotes = F.length(tail) - F.length(F.replace(tail, F.lit('"'), F.lit("")))
    reopened = F.concat(
        F.lit("{"), F.rtrim(F.rtrim(tail, F.lit(fv.WHITE_SPACE)), F.lit(",")),
        F.when(quotes % 2 == 1, F.lit('"')).otherwise(F.lit("")), F.lit("}")
    )
    return (
        F.when(~text.contains("{"), text)
        .when(tail.contains("}"), closed)
        .otherwise(reopened)
    )


def read_object(text: Column | str, keys: Sequence[str],
                control_chars: bool = False) -> Column:
    """The named members of a text that is exactly one strict JSON object, else null.

    ``from_json`` stops at the end of the first value, so the text is read as an
    array with a marker object behind it: anything after the object, or a second
    object, leaves the marker out of place. The last of repeated names wins.
    """
    members = ", ".join(f"`{k}` variant" for k in keys)
    options = {"allowSingleQuotes": "false"}
    if control_chars:
        options["allowUnquotedControlChars"] = "true"
    items = F.from_json(
        F.concat(F.lit("["), _col(text), F.lit(f',{{"{_END}":1}}]')),
        f"array<struct<{members}, {_END} int>>", options,
    )

    def only(found: Column) -> Column:
        marker = F.try_element_at(found, F.lit(2)).getField(_END)
        return F.when((F.size(found) == 2) & (marker == 1), F.try_element_at(found, F.lit(1)))

    return bind(items, only)


def is_filled(value: Column) -> Column:
    """Whether a JSON value is other than empty, zero, false or null.

    The JSON type decides: the number 0 is empty, the text "0" is not.
    """
    text = value.cast("string")
    kind = F.schema_of_variant(value)
    number = text.try_cast("double")
    return (
        F.when(value.isNull() | (kind == "VOID"), F.lit(False))
        .when(kind == "STRING", text != "")
        .when(kind == "BOOLEAN", text == "true")
        .when(kind.startswith("ARRAY"), text != "[]")
        .when(kind.startswith("OBJECT"), text != "{}")
        .otherwise(number.isNull() | (number != 0))
    )


def first_alias(members: Column, keys: Sequence[str]) -> Column:
    """The first filled value among the names, in their order, as text."""
    def pick(found: Column) -> Column:
        values = F.array(*[found.getField(k) for k in keys])
        return F.try_element_at(F.filter(values, is_filled), F.lit(1)).cast("string")

    return bind(members, pick)


def parse_replies(df: DataFrame, raw: str = "raw_response",
                  vote_keys: Sequence[str] = fv.VOTE_KEYS,
                  reason_keys: Sequence[str] = fv.REASON_KEYS,
                  control_chars: bool = False) -> DataFrame:
    """Add ``vote``, ``reason``, ``salvaged`` and ``error`` to a reply table.

    ``error`` is null exactly when both fields were found; a salvaged reason may
    end in mid-sentence. An ``error`` column already present (a call that failed)
    is kept. ``control_chars`` also accepts raw line breaks inside strings.
    """
    keys = (*vote_keys, *reason_keys)
    called = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    kept = [c for c in df.columns if c not in ("vote", "reason", "salvaged", "error")]
    parsed = (
        df.withColumn("_text", strip_noise(raw))
        .withColumn("_strict", read_object(outer_object("_text"), keys, control_chars))
        .withColumn("_repaired", F.when(F.col("_strict").isNull(), close_object("_text")))
        .withColumn("_closed", read_object("_repaired", keys, control_chars))
        .withColumn("_members", F.coalesce("_strict", "_closed"))
        .withColumn("_vote", first_alias(F.col("_members"), vote_keys))
        .withColumn("_reason", first_alias(F.col("_members"), reason_keys))
    )
    names = F.array_join(
        F.json_object_keys(F.coalesce(F.col("_repaired"), outer_object("_text"))), "', '"
    )
    problem = (
        F.when(F.col("_members").isNull(), F.concat(
            F.lit("no parseable JSON in response: "),
            F.coalesce(preview(raw, 200), F.lit(""))))
        .when(F.col("_vote").isNull() | F.col("_reason").isNull(), F.concat(
            F.lit("missing keys: ["),
            F.when(names != "", F.concat(F.lit("'"), names, F.lit("'"))).otherwise(F.lit("")),
            F.lit("]")))
    )
    result = F.struct(
        F.col("_vote").alias("vote"), F.col("_reason").alias("reason"),
        (F.col("_strict").isNull() & F.col("_closed").isNotNull()).alias("salvaged"),
        F.coalesce(called, problem).alias("error"),
    )
    # As a generator's output the fields are computed once: the optimizer would copy the
    # whole chain into every filter and use of a plain column.
    return parsed.select(*kept, F.inline(F.array(result)))


def is_good(vote: Column | str = "vote", reason: Column | str = "reason") -> Column:
    """Both required fields are present and non-empty."""
    return F.coalesce((_col(vote) != "") & (_col(reason) != ""), F.lit(False))


def split_replies(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters) of a parsed reply table.

    Both sides read ``parsed``: pass a stored table, or the calls behind it run twice.
    """
    good = parsed.where(F.col("error").isNull()).drop("error")
    bad = parsed.where(F.col("error").isNotNull()).drop("vote", "reason", "salvaged")
    return good, bad
