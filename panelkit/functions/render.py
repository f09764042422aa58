"""Text rendering: profile cards, prompts, profile and summary lines."""

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelkit import fixed_values as fv
from panelkit.functions.columns import _col, preview, tenths_text

def strip(text: Column | str) -> Column:
    """Trim white space of every script; a plain ``F.trim`` takes spaces only."""
    return F.trim(_col(text), F.lit(fv.WHITE_SPACE))


def _bullet(label: str, value: Column) -> Column:
    """``- label: value``; null, and so left out by ``concat_ws``, when there is no value."""
    return F.when(value != "", F.concat(F.lit(f"- {label}: "), value))


def _section(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"[{label}]\n"), value)


def card(columns: Mapping[str, str] | None = None,
         labels: Mapping[str, str] = fv.CARD_LABELS,
         narratives: Mapping[str, str] = fv.CARD_NARRATIVES,
         interest: Column | str | None = None) -> Column:
    """A profile as labelled bullets and narrative sections.

    ``columns`` maps a card field to the table's column where the names differ.
    Empty and null fields give no bullet, null narratives no section. ``interest``
    adds a last block when it holds more than white space.
    """
    columns = columns or {}

    def source(name: str) -> Column:
        return F.col(columns.get(name, name)).cast("string")

    values = {
        "age": lambda: F.concat(source("age"), F.lit(fv.AGE_SUFFIX)),
        "region": lambda: F.concat_ws(" ", source("province"), source("district")),
    }
    bullets = [_bullet(label, values.get(n, lambda n=n: source(n))()) for n, label in labels.items()]
    sections = [_section(label, source(n)) for n, label in narratives.items()]
    text = F.concat(
        F.lit(fv.CARD_DEMOGRAPHICS_HEADING + "\n"), F.concat_ws("\n", *bullets),
        F.lit("\n\n" + fv.CARD_NARRATIVE_HEADING + "\n"), F.concat_ws("\n\n", *sections),
    )
    return text if interest is None else with_block(text, interest)


def with_block(text: Column | str, block: Column | str,
               heading: str = fv.CARD_INTEREST_HEADING) -> Column:
    """The text, with a headed block after it unless the block is blank or null."""
    trimmed = strip(block)
    return F.concat_ws(
        "\n\n", _col(text), F.when(trimmed != "", F.concat(F.lit(heading + "\n"), trimmed))
    )


def _token_pattern(slots: Mapping[str, Column | str]) -> str:
    names = "|".join(r"\{" + name + r"\}" for name in slots)
    return r"(\{\{|\}\}|" + names + r"|[^{}]+|[{}])"


def fill_text(template: str, slots: Mapping[str, Column | str]) -> Column:
    """``fill_template`` for one template text: its tokens are cut here, rows only concatenate."""
    parts = []
    for token in re.findall(_token_pattern(slots), template):
        if token in "{}":
            raise ValueError("the template has a stray brace or an unknown slot")
        slot = slots.get(token[1:-1]) if token[0] + token[-1] == "{}" else None
        parts.append(F.lit({"{{": "{", "}}": "}"}.get(token, token)) if slot is None
                     else _col(slot))
    return F.concat(*parts)


def fill_template(template: Column | str, slots: Mapping[str, Column | str]) -> Column:
    """Fill ``{name}`` slots of a template column and unescape ``{{`` and ``}}`` in one pass.

    The template is cut into tokens first and each token is replaced on its own,
    so braces inside inserted text are never read as slots. An unknown slot or a
    stray brace gives null, for the caller to send to the dead letters.
    """
    tokens = F.regexp_extract_all(_col(template), F.lit(_token_pattern(slots)), 1)

    def fill(token: Column) -> Column:
        out = F.when(token == "{{", "{").when(token == "}}", "}")
        for name, value in slots.items():
            out = out.when(token == "{" + name + "}", _col(value))
        return out.otherwise(token)

    stray = F.arrays_overlap(tokens, F.array(F.lit("{"), F.lit("}")))
    return F.when(~stray, F.array_join(F.transform(tokens, fill), ""))


def user_message(model: Column | str, card: Column | str,
                 template: str = fv.USER_TEMPLATE) -> Column:
    """The user message around a card, with the no-thinking suffix for models that need it."""
    needs = F.lower(_col(model)).contains(fv.NO_THINK_MODEL)
    suffix = F.when(needs, fv.NO_THINK_SUFFIX).otherwise("")
    return F.concat(fill_text(template, {fv.CARD_SLOT: card}), suffix)


def profile_line(columns: Mapping[str, str] | None = None) -> Column:
    """``sex age · region`` and the household, schooling and work of one profile."""
    columns = columns or {}

    def source(name: str) -> Column:
        return F.col(columns.get(name, name)).cast("string")

    field = source("bachelors_field")
    schooling = F.concat(
        source("education_level"),
        F.when(field != fv.NO_FIELD_OF_STUDY, F.concat(F.lit(" ("), field, F.lit(")")))
        .otherwise(F.lit("")),
    )
    return F.concat_ws(
        " · ",
        F.concat(source("sex"), F.lit(" "), source("age"), F.lit(fv.AGE_SUFFIX)),
        F.concat_ws(" ", source("province"), source("district")),
        source("marital_status"), source("family_type"), source("housing_type"),
        schooling, source("occupation"),
    )


def summary_line(position: Column | str, total: Column | str, sex: Column | str,
                 age: Column | str, province: Column | str, occupation: Column | str,
                 answer: Column | str, seconds: Column | str | None = None,
                 file_name: Column | str | None = None) -> Column:
    """The fixed-width progress line of one answered row.

    With ``seconds`` and ``file_name`` it ends with the latency and where the reply is.
    """
    line = F.format_string(
        f"[%3d/%d] %s %d{fv.AGE_SUFFIX} %-6s %-14s → %-10s",
        _col(position), _col(total), _col(sex), _col(age), _col(province),
        preview(occupation, 14), preview(answer, 10),
    )
    if seconds is None or file_name is None:
        return line
    return F.concat(line, F.lit(" ("), tenths_text(seconds), F.lit("s) → "), _col(file_name))


def answer_or_none(answer: Column | str) -> Column:
    return F.coalesce(_col(answer), F.lit(fv.NO_ANSWER))
