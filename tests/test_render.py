import pytest
from pyspark.sql import functions as F

from panelkit.functions import render
from panelkit.schemas import DEMOGRAPHICS, NARRATIVES

COLUMNS = [*DEMOGRAPHICS, "persona_summary", *NARRATIVES, "political_interest"]


def person(spark, **values):
    schema = ", ".join(f"{c} {'int' if c == 'age' else 'string'}" for c in COLUMNS)
    return spark.createDataFrame([tuple(values.get(c) for c in COLUMNS)], schema)


def test_card(spark):
    df = person(
        spark, sex="여자", age=52, marital_status="", housing_type="아파트", province="경기",
        district="안산시", persona_summary="요약문", professional_persona="일",
        family_persona="", hobbies_and_interests="등산", political_interest="\u3000 관심\n")
    want = (
        "## 인구통계\n- 성별: 여자\n- 연령: 52세\n- 주거: 아파트\n- 지역: 경기 안산시\n\n"
        "## 인물 서사\n[요약]\n요약문\n\n[직업적 면모]\n일\n\n[가족 면모]\n\n\n[관심사]\n등산")
    assert df.select(render.card()).first()[0] == want
    assert df.select(render.card(interest="political_interest")).first()[0] == (
        want + "\n\n## 정치적 이해관계\n[정치적 이해관계]\n관심")


@pytest.mark.parametrize("block", [None, "", " \t\n\u3000\x1c"])
def test_blank_block_is_left_out(spark, block):
    df = spark.createDataFrame([("card", block)], "c string, b string")
    assert df.select(render.with_block("c", "b")).first()[0] == "card"


def test_strip_matches_python(spark):
    texts = ["\x1c\x85 a b \u2028\u00a0", "\n\nx", "y\v\f", "z", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(render.strip("t")).collect()] == [t.strip() for t in texts]


TEMPLATES = [
    "plain", "{a}", "x {a} y {b}", '{{"vote": "{a}"}}', "{{{a}}}", "{{a}} {b}", "{a}{a}", "{{}}"]


@pytest.mark.parametrize("template", TEMPLATES)
def test_template_matches_format(spark, template):
    values = {"a": "{b} {{x}}", "b": "$1 \\ }"}
    df = spark.createDataFrame([(template, values["a"], values["b"])], "t string, a string, b string")
    slots = {"a": F.col("a"), "b": F.col("b")}
    got = df.select(render.fill_template("t", slots), render.fill_text(template, slots)).first()
    assert tuple(got) == (template.format(**values),) * 2


@pytest.mark.parametrize("template", ["{", "a } b", "{other}", "{a}}"])
def test_bad_template(spark, template):
    df = spark.createDataFrame([(template, "x")], "t string, a string")
    assert df.select(render.fill_template("t", {"a": F.col("a")})).first()[0] is None
    with pytest.raises(ValueError):
        render.fill_text(template, {"a": F.col("a")})


def test_no_think_suffix(spark):
    df = spark.createDataFrame([("ollama/Qwen3:32b",), ("gemma",)], "m string")
    got = [r[0] for r in df.select(render.user_message("m", F.lit("CARD"))).collect()]
    assert got[0] == got[1] + "\n\n/no_think" and "\n\nCARD\n\n" in got[1]


def test_profile_line(spark):
    base = dict(sex="남자", age=26, marital_status="미혼", family_type="동거", housing_type="아파트",
                education_level="대학교", occupation="무직", province="인천", district="남동구")
    head = "남자 26세 · 인천 남동구 · 미혼 · 동거 · 아파트 · "
    for field, schooling in (("공학", "대학교 (공학)"), ("해당없음", "대학교"), (None, "대학교")):
        line = person(spark, **base, bachelors_field=field).select(render.profile_line()).first()[0]
        assert line == head + schooling + " · 무직"


def test_summary_line_and_default(spark):
    df = spark.createDataFrame([(3, 30, "남자", 26, "인천", "아주 긴 직업 이름 열네 글자 넘김", "답")],
                               "i int, n int, s string, a int, p string, o string, v string")
    line = df.select(render.summary_line("i", "n", "s", "a", "p", "o", "v")).first()[0]
    want = "[{:>3}/{}] {} {}세 {:<6} {:<14} → {:<10}".format(
        3, 30, "남자", 26, "인천", "아주 긴 직업 이름 열네 글자 넘김"[:14], "답")
    assert line == want
    assert df.select(render.answer_or_none(F.lit(None).cast("string"))).first()[0] == "(없음)"
