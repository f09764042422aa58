"""Scalar column helpers: buckets, rounding, names, versions, lookups."""

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit import fixed_values as fv

# Letters and numbers of any script, underscore, dash and dot stay in a file name.
UNSAFE_NAME_CHARS = r"[^\p{L}\p{N}_\-.]"
RESPONSE_NAME = (
    r"^(FAIL_)?(\d{8}-\d{6})_(.+)_([0-9A-Za-z]{8})(?:_(v\d+))?(?:_(v\d+))?\.(?:json|txt)$"
)
_GROUP_MARK = "\x01"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it.

    Spark has no let-expression; a one-element array and its element variable are one.
    """
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))


def bucket(value: Column | str, edges: Sequence[float] = fv.AGE_EDGES,
           labels: Sequence[str] = fv.AGE_LABELS) -> Column:
    """Label of the band (low, high] that holds the value; null outside all bands."""
    value, out = _col(value), None
    for low, high, label in zip(edges[:-1], edges[1:], labels, strict=True):
        inside = (value > F.lit(low)) & (value <= F.lit(high))
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def bucket_rank(label: Column | str, labels: Sequence[str] = fv.AGE_LABELS) -> Column:
    """Position of a band label, from 0; null for any other text."""
    return F.nullif(F.array_position(F.array(*map(F.lit, labels)), _col(label)), F.lit(0)) - 1


def round_half_even(value: Column | str, digits: int) -> Column:
    """Scale, round to the nearest even integer, scale back: what pandas ``round`` does."""
    power = F.lit(float(10**digits))
    return F.rint(_col(value) * power) / power


def tenths_text(value: Column | str) -> Column:
    """The exact binary value to one decimal, ties to even, as ``f"{x:.1f}"`` prints it.

    ``format_string`` alone rounds the shortest decimal text of the double half up.
    Here x*10 is the sum of two exact products, so its rounding error is known and
    decides the cases where the product lands on a tie.
    """
    x = _col(value).cast("double")
    eight, two = x * 8.0, x * 2.0
    total = eight + two
    part = total - eight
    error = (eight - (total - part)) + (two - part)
    tie = (total - F.floor(total)) == 0.5
    whole = (
        F.when(tie & (error > 0), F.ceil(total).cast("double"))
        .when(tie & (error < 0), F.floor(total).cast("double"))
        .otherwise(F.rint(total))
    )
    return F.format_string("%.1f", whole / 10.0)


def with_default_version(version: Column | str) -> Column:
    return F.coalesce(_col(version), F.lit(fv.UNKNOWN_VERSION))


def key_prefix(key: Column | str) -> Column:
    return F.substring(_col(key), 1, 8)


def model_key(provider: Column | str, model: Column | str) -> Column:
    return F.concat_ws("/", _col(provider), _col(model))


def safe_name(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), UNSAFE_NAME_CHARS, "_")


def response_name(timestamp: Column | str, model: Column | str, key: Column | str,
                  version: Column | str, provider: Column | str | None = None) -> Column:
    """``{time}_{provider}_{model}_{key8}_{version}_{version}.json``; null parts are left out."""
    parts = [_col(timestamp)]
    if provider is not None:
        parts.append(safe_name(provider))
    parts += [safe_name(model), key_prefix(key), _col(version), _col(version)]
    return F.concat(F.concat_ws("_", *parts), F.lit(".json"))


def response_name_parts(name: Column | str) -> Column:
    """A struct of the parts of a response or failure file name; absent parts are null.

    The name is matched once: its groups are written out with a separator and split.
    """
    groups = _GROUP_MARK.join(f"${i}" for i in range(1, 7))
    split = F.split(F.regexp_replace(_col(name), RESPONSE_NAME, groups), _GROUP_MARK)

    def parts(found: Column) -> Column:
        matched = F.size(found) == 6

        def part(i: int) -> Column:
            return F.when(matched & (found[i] != ""), found[i])

        return F.struct(
            (matched & (found[0] != "")).alias("failed"),
            part(1).alias("timestamp"),
            part(2).alias("model"),
            part(3).alias("key8"),
            part(4).alias("voter_context_version"),
            part(5).alias("system_prompt_version"),
        )

    return bind(split, parts)


def event_time(text: Column | str) -> Column:
    """The time in a ``yyyyMMdd-HHmmss`` text; null when it is not one."""
    return F.try_to_timestamp(_col(text), F.lit(fv.TIMESTAMP_FORMAT))


def log_order(response_file: Column | str = "response_file") -> Column:
    """An order for the log: the time its file names start with, ties by the rest of the name.

    The log has no time column of its own and a distributed table no file order. The
    time has a fixed width and leads the name, so the plain name sorts that way.
    """
    return _col(response_file)


def utc_name(name: Column | str, zone: str) -> Column:
    """A response file name whose leading local time of ``zone`` is put in UTC.

    Workers stamp UTC; names brought in from elsewhere are put in the same clock, or the
    order of the log would be wrong by the offset. Names without a time stay.
    """
    name = _col(name)
    stamp = F.regexp_extract(name, r"^(\d{8}-\d{6})(?=_)", 1)
    at = F.date_format(F.to_utc_timestamp(event_time(stamp), zone), fv.TIMESTAMP_FORMAT)
    return F.coalesce(F.concat(at, F.substring(name, F.lit(16), F.length(name))), name)


def all_present(*columns: str) -> Column:
    """No column is null; unlike ``dropna`` a predicate the scan can push down."""
    out = F.lit(True)
    for name in columns:
        out = out & F.col(name).isNotNull()
    return out


def version_number(version: Column | str) -> Column:
    """The whole number after the ``v``, so that v10 sorts after v9; null without one.

    As a decimal of 38 digits it holds dated versions of any precision.
    """
    return F.nullif(F.regexp_extract(_col(version), r"^v(\d+)$", 1), F.lit("")).try_cast(
        "decimal(38,0)")


def lookup(key: Column | str, values: Mapping[str, str] = fv.ANSWER_COLORS,
           default: str = fv.DEFAULT_COLOR) -> Column:
    """The value listed for a key, or the default.

    The list is one literal of the plan, whatever its length; a list that is a table
    belongs in a join (``operators.joins.lookup_join``).
    """
    text = json.dumps(dict(values), ensure_ascii=False)
    listed = F.from_json(F.lit(text), "map<string,string>")
    return F.coalesce(F.try_element_at(listed, _col(key)), F.lit(default))


def preview(text: Column | str, length: int) -> Column:
    return F.substring(_col(text), 1, length)


def facets(df: DataFrame, ids: Sequence[str],
           labels: Mapping[str, str] = fv.FACET_LABELS) -> DataFrame:
    """One (label, text) row per non-null text column, in one pass over the rows."""
    present = [c for c in labels if c in df.columns]
    pairs = F.array(*[
        F.struct(F.lit(labels[c]).alias("label"), F.col(c).cast("string").alias("text"))
        for c in present
    ])
    return df.select(*ids, F.inline(pairs)).where(F.col("text").isNotNull())


def with_suffix(df: DataFrame, columns: Sequence[str], suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}_{suffix}" for c in columns})
