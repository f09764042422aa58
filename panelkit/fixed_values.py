"""Labels, keys, edges and formats that results must agree on.

They are plain data, listed in their natural order. Nothing here is computed.
"""

# Age bands: right-closed edges and the label of each band, young to old.
AGE_EDGES = (0, 29, 39, 49, 59, 69, 200)
AGE_LABELS = ("20대", "30대", "40대", "50대", "60대", "70+")

# Display colour of each known answer, and of any other answer.
ANSWER_COLORS = {
    "더불어민주당": "#004EA2",
    "국민의힘": "#E61E2B",
    "개혁신당": "#FF7920",
    "조국혁신당": "#06275E",
    "진보당": "#D6001C",
    "자유통일당": "#8E44AD",
    "무당층/기권": "#9E9E9E",
}
DEFAULT_COLOR = "#666"

# Names a reply may use for the answer and for its reason, in order of preference.
VOTE_KEYS = ("vote", "party", "정당", "지지정당", "투표", "선택", "지지")
REASON_KEYS = ("reason", "이유", "rationale", "사유", "근거", "설명")

# Profile card: headings, bullet labels and narrative labels.
CARD_DEMOGRAPHICS_HEADING = "## 인구통계"
CARD_NARRATIVE_HEADING = "## 인물 서사"
CARD_INTEREST_HEADING = "## 정치적 이해관계\n[정치적 이해관계]"
CARD_LABELS = {
    "sex": "성별",
    "age": "연령",
    "marital_status": "혼인상태",
    "family_type": "가구형태",
    "housing_type": "주거",
    "education_level": "학력",
    "bachelors_field": "전공",
    "occupation": "직업",
    "region": "지역",
}
CARD_NARRATIVES = {
    "persona_summary": "요약",
    "professional_persona": "직업적 면모",
    "family_persona": "가족 면모",
    "cultural_background": "문화적 배경",
    "hobbies_and_interests": "관심사",
    "career_goals_and_ambitions": "목표",
}
AGE_SUFFIX = "세"

# Detail view of the narratives, in display order.
FACET_LABELS = {
    "professional_persona": "직업적 면모",
    "family_persona": "가족 면모",
    "cultural_background": "문화적 배경",
    "sports_persona": "스포츠",
    "arts_persona": "예술",
    "travel_persona": "여행",
    "culinary_persona": "음식",
    "hobbies_and_interests": "관심사",
    "skills_and_expertise": "숙련·전문성",
    "career_goals_and_ambitions": "목표·포부",
}

# Columns of the raw view and of the feed's filters, in display order.
RAW_VIEW = (
    "persona_uuid", "model", "vote", "sex", "age", "province", "district", "occupation",
    "education_level", "reason", "elapsed_sec",
)
FACETS = ("sex", "province", "occupation", "education_level")

# Stand-ins for absent values.
NO_FIELD_OF_STUDY = "해당없음"
NO_ANSWER = "(없음)"
UNKNOWN_VERSION = "?"

# Prompt slots, the user message, and the suffix that switches off a model's thinking.
CONTEXT_SLOT = "political_context"
CARD_SLOT = "persona_card"
USER_TEMPLATE = (
    "다음 페르소나가 2026년 6월 3일 지방선거(또는 가까운 미래의 총선·대선)에서 "
    "어느 정당을 지지·투표할지 추론하시오.\n\n{persona_card}\n\nJSON만 출력."
)
NO_THINK_MODEL = "qwen3"
NO_THINK_SUFFIX = "\n\n/no_think"

# White space of every script, as str.isspace counts it.
WHITE_SPACE = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Event-time text and the names that carry it.
TIMESTAMP_FORMAT = "yyyyMMdd-HHmmss"
CHUNK_SIZE = 10
