"""Cards, prompts, names and other text columns."""

from pyspark.sql import functions as F

from panelkit import fixed_values as fv
from panelkit.functions import columns, render
from panelkit.queries.base import LOG, SPACE, log, query, table

CARD_COLUMNS = {
    "sex": "lang", "age": "n_chars", "marital_status": "quality", "family_type": "toxic",
    "province": "source", "district": "lang", "persona_summary": "text",
}
CARD_LABELS = {k: fv.CARD_LABELS[k] for k in
               ("sex", "age", "marital_status", "family_type", "region")}
CARD_NARRATIVES = {"persona_summary": fv.CARD_NARRATIVES["persona_summary"]}


def _literal(text: str) -> str:
    """A text as SQL, with its line feeds."""
    return " || chr(10) || ".join(f"'{part}'" for part in text.split("\n"))


_LABEL = {name: f"'- {label}: '" for name, label in CARD_LABELS.items()}
CARD_SQL = f"""{_literal(fv.CARD_DEMOGRAPHICS_HEADING)} || chr(10) || concat_ws(chr(10),
    {_LABEL['sex']} || nullif(lang, ''), {_LABEL['age']} || n_chars || '{fv.AGE_SUFFIX}',
    {_LABEL['marital_status']} || quality, {_LABEL['family_type']} || toxic,
    {_LABEL['region']} || source || ' ' || lang)
  || chr(10) || chr(10) || {_literal(fv.CARD_NARRATIVE_HEADING)} || chr(10)
  || '[{CARD_NARRATIVES["persona_summary"]}]' || chr(10) || text"""


def documents_with_labels(spark, folder):
    return table(spark, folder, "documents").join(
        table(spark, folder, "labels"), "doc_id", "left")


@query(f"""SELECT d.doc_id, {CARD_SQL} AS card
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def render_card(spark, folder):
    card = render.card(CARD_COLUMNS, CARD_LABELS, CARD_NARRATIVES)
    return documents_with_labels(spark, folder).select("doc_id", card.alias("card"))


@query(f"""SELECT conv_id, turn, CASE WHEN trimmed <> ''
  THEN 'turn ' || turn || chr(10) || chr(10) || {_literal(fv.CARD_INTEREST_HEADING)}
       || chr(10) || trimmed
  ELSE 'turn ' || turn END AS card
FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN
        regexp_replace('  ' || text || chr(10), '^{SPACE}+|{SPACE}+$', '', 'g')
        ELSE '' END AS trimmed FROM conversations)""")
def card_optional_block(spark, folder):
    block = F.when(F.col("role") == "user", F.concat(F.lit("  "), "text", F.lit("\n")))
    head = F.concat(F.lit("turn "), F.col("turn").cast("string"))
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", render.with_block(head, block).alias("card"))


@query("""SELECT page_id, html || chr(10) || url || ' {persona_card}' AS prompt FROM pages""")
def fill_template(spark, folder):
    # The page's own braces are escaped and must come back; the slot text holds another slot.
    escaped = F.replace(F.replace("html", F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))
    template = F.concat(escaped, F.lit("\n{political_context}{persona_card}"))
    filled = render.fill_template(template, {
        fv.CONTEXT_SLOT: F.concat("url", F.lit(" {persona_card}")), fv.CARD_SLOT: F.lit("")})
    return table(spark, folder, "pages").select("page_id", filled.alias("prompt"))


MESSAGE = "Who is this?\n{persona_card}\nOne word {{only}}."


@query(f"""SELECT doc_id, 'Who is this?' || chr(10) || text || chr(10) || 'One word {{only}}.'
  || CASE WHEN lang = 'de' THEN {_literal(fv.NO_THINK_SUFFIX)} ELSE '' END AS prompt
FROM documents""")
def no_think_suffix(spark, folder):
    model = F.when(F.col("lang") == "de", "Qwen3:32b").otherwise(F.col("lang"))
    prompt = render.user_message(model, "text", MESSAGE)
    return table(spark, folder, "documents").select("doc_id", prompt.alias("prompt"))


@query(r"""SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}_\-.]', '_', 'g') AS name FROM pages""")
def safe_name(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", columns.safe_name("url").alias("name"))


NAMED = f"""WITH {LOG}, n AS (
  SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS t, replace(model, '/', '_') AS model,
         left(md5(CAST(persona AS VARCHAR)), 8) AS key8, version FROM log)"""


def _names(spark, folder):
    at = F.date_format("ts", fv.TIMESTAMP_FORMAT)
    key = F.md5(F.col("persona").cast("string"))
    return log(spark, folder).select(
        "event_id", columns.response_name(at, "model", key, "version").alias("name"))


@query(f"""{NAMED} SELECT event_id,
  concat_ws('_', t, model, key8, version, version) || '.json' AS name FROM n""")
def response_names(spark, folder):
    return _names(spark, folder)


@query(f"""{NAMED} SELECT event_id, false AS failed, t AS timestamp, model, key8,
  version AS voter_context_version, version AS system_prompt_version,
  strptime(t, '%Y%m%d-%H%M%S') AS taken_at FROM n""")
def name_parts(spark, folder):
    parts = columns.response_name_parts("name")
    return _names(spark, folder).select("event_id", parts.alias("p")).select(
        "event_id", "p.*", columns.event_time("p.timestamp").cast("timestamp_ntz").alias("taken_at"))


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN '#E61E2B'
  WHEN '2-HIGH' THEN '#FF7920' ELSE '#666' END AS color FROM orders""")
def lookup_default(spark, folder):
    colors = {"1-URGENT": "#E61E2B", "2-HIGH": "#FF7920"}
    return table(spark, folder, "orders").select(
        "o_orderkey", columns.lookup("o_orderpriority", colors).alias("color"))


@query("""SELECT c_custkey, concat_ws(' · ', c_mktsegment || ' ' || c_custkey || '세',
  concat_ws(' ', n_name, r_name), c_name,
  CASE WHEN c_mktsegment = 'BUILDING' THEN n_name ELSE n_name || ' (' || c_mktsegment || ')' END,
  c_name) AS line
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def profile_line(spark, folder):
    people = (
        table(spark, folder, "customer")
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumn("field", F.when(F.col("c_mktsegment") == "BUILDING", fv.NO_FIELD_OF_STUDY)
                    .otherwise(F.col("c_mktsegment")))
        .withColumn("absent", F.lit(None).cast("string"))
    )
    line = render.profile_line({
        "sex": "c_mktsegment", "age": "c_custkey", "province": "n_name", "district": "r_name",
        "marital_status": "c_name", "family_type": "absent", "housing_type": "absent",
        "education_level": "n_name", "bachelors_field": "field", "occupation": "c_name"})
    return people.select("c_custkey", line.alias("line"))


@query("""SELECT s_suppkey, printf('[%3d/%d] %s %d세 %-6s %-14s → %-10s', s_suppkey, s_suppkey * 2,
  'S', s_nationkey, 'N' || s_nationkey, left(s_name, 14), left(s_name, 10)) AS line
FROM supplier""")
def summary_line(spark, folder):
    nation = F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))
    line = render.summary_line(
        "s_suppkey", F.col("s_suppkey") * 2, F.lit("S"), "s_nationkey", nation, "s_name", "s_name")
    return table(spark, folder, "supplier").select("s_suppkey", line.alias("line"))


@query("""SELECT doc_id, left(text, 120) AS short, left(text, 300) AS long FROM documents""")
def preview(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", columns.preview("text", 120).alias("short"),
        columns.preview("text", 300).alias("long"))


@query(f"""SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), '{fv.NO_ANSWER}') AS answer
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def answer_default(spark, folder):
    answer = render.answer_or_none(F.col("quality").cast("string"))
    return documents_with_labels(spark, folder).select("doc_id", answer.alias("answer"))


@query("""SELECT p_partkey, 'name' AS label, p_name AS text FROM part WHERE p_name IS NOT NULL
UNION ALL SELECT p_partkey, 'brand', p_brand FROM part WHERE p_brand IS NOT NULL
UNION ALL SELECT p_partkey, 'type', p_type FROM part
  WHERE p_type IS NOT NULL AND p_type <> 'PROMO'""")
def unpivot_facets(spark, folder):
    part = table(spark, folder, "part").withColumn("p_type", F.nullif("p_type", F.lit("PROMO")))
    return columns.facets(part, ["p_partkey"],
                          {"p_name": "name", "p_brand": "brand", "p_type": "type"})
