"""Schemas of the tables the library reads and writes.

The column names are fixed values: files and results must agree on them.
"""

from pyspark.sql import types as T

DEMOGRAPHICS = (
    "sex", "age", "marital_status", "family_type", "housing_type",
    "education_level", "bachelors_field", "occupation", "province", "district",
)
NARRATIVES = (
    "professional_persona", "sports_persona", "arts_persona", "travel_persona",
    "culinary_persona", "family_persona", "cultural_background",
    "skills_and_expertise", "hobbies_and_interests", "career_goals_and_ambitions",
)


def _field(name: str) -> T.StructField:
    types = {"age": T.IntegerType(), "elapsed_sec": T.DoubleType()}
    return T.StructField(name, types.get(name, T.StringType()))


def _schema(*names: str) -> T.StructType:
    return T.StructType([_field(n) for n in names])


PERSONA = _schema("uuid", *DEMOGRAPHICS, "persona", *NARRATIVES)

RESPONSE_LOG = _schema(
    "persona_uuid", *DEMOGRAPHICS, "persona_summary", "vote", "reason", "model",
    "elapsed_sec", "response_file", "voter_context_version",
    "system_prompt_version", *NARRATIVES,
)

# A superset of the three document layouts; fields a file lacks read as null.
RESPONSE_DOCUMENT = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("voter_context_version", T.StringType()),
    T.StructField("system_prompt_version", T.StringType()),
    T.StructField("persona_uuid", T.StringType()),
    T.StructField("elapsed_sec", T.DoubleType()),
    T.StructField("persona", _schema(*DEMOGRAPHICS, "persona_summary")),
    T.StructField("political_interest", T.StringType()),
    T.StructField("raw_response", T.StringType()),
    T.StructField("parsed", _schema("vote", "reason")),
])

DEAD_LETTER = _schema("file_name", "error", "model", "persona_uuid", "raw_response")
INTERESTS = _schema("persona_uuid", "political_interest")
PROMPT_ASSETS = _schema("kind", "version", "text")
