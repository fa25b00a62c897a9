"""Text and date rules on Korean fixtures, each with the quirk it keeps."""

import datetime

import pytest
from pyspark.sql import functions as F

from regscope.functions import dates, ids
from regscope.functions import text as T
from regscope.operators import classify as C


@pytest.fixture(scope="module")
def value(spark):
    return lambda column: spark.range(1).select(column.alias("v")).first().v


L = F.lit


def cases():
    return [
        (dates.norm_bill_date(L("2026. 2. 4.")), "2026.02.04."),
        (dates.norm_bill_date(L("none")), "none"),
        (dates.norm_case_date(L("20250925")), "2025.09.25."),
        (dates.norm_case_date(L("2025. 9. 25.")), "2025. 9. 25."),  # two signs between the parts
        (dates.norm_reply_date(L("2026-04-02")), "2026.04.02."),
        (dates.display_date(L("2026-04-23")), "'26.4.23(목)"),
        (dates.display_date(L("2026-02-31")), "2026-02-31"),
        (dates.event_date(L("공포 (2026. 3. 9.)"), L("2025-01-01")), "2026-03-09"),
        (dates.event_date(L("심사"), L("2025.1.1")), "2025-01-01"),
        (dates.press_date(L("x\n◆ 기관 '26. 4. 3.(금)"), L("2026-01-01").cast("date")), "20260403"),
        (dates.proposal_date(L("의원 10인 (2026. 1. 5.)")), "2026.01.05."),
        (dates.age_date(L("2026.02.31")), None),
        (dates.news_date(L("Thu, 9 Apr 2026 23:30:00 +0900")), datetime.date(2026, 4, 9)),
        (dates.news_date(L("bad")), None),
        (T.strip_html(L("<p>a&amp;lt;b</p><br/>c&nbsp;d<u>e</u>")), "a<b\n\nc de"),
        (T.normalize_summary(L("「 법 」 ‘가’・나...\n\n\n 다  라 ")), "「법」 '가'·나…\n\n다 라"),
        (T.truncate_sentence(L("하나다. 둘이다. 셋"), 9), "하나다. 둘이다."),
        (T.normalize_case_body(L("[이유]\n첫 줄이\n이어진다.\n□\n항목 하나\n제 3 조 에 따라 .")), "[이유]\n\n첫 줄이 이어진다.\n□ 항목 하나\n제3조 에 따라."),
        (T.strip_brackets(L("[단독] 금융위, \"따옴표\" 개정안 — 부제 [더")), "금융위, 개정안"),
        (T.title_summary(L("[단독] '가상자산' 규제… 강화 [전")), "가상자산 규제 강화"),
        (T.noun_ending(L("자금세탁이 적발됐다.")), "자금세탁이 적발"),
        (T.noun_ending(L("제도가 필요하다.")), "제도가 필요"),
        (T.noun_ending(L("영향이 있다.")), "영향이 있음"),
        (T.format_statute_body(L("본문이다. ① 첫째 ②둘째 1. 가나")), "본문이다.\n① 첫째\n②둘째 1. 가나"),
        (T.normalize_question(L("  STR   보고  기한?")), "str 보고 기한?"),
        (T.norm_heading(L("제안 이유 및 주요·내용")), "제안이유및주요내용"),
        (T.strip_bullet_prefix(L(" - · • 항목 ")), "항목"),
        (T.clean_ui_noise(L("본문 입력 2026.04.03 10:30 기자 a@b.com 공유하기 끝")), "본문 기자 끝"),
        (F.array_join(T.split_bullets(L("첫째 항목입니다 - 둘째 항목입니다")), "|"), "첫째 항목입니다|둘째 항목입니다"),
        (F.array_join(T.split_bullets(L("짧다")), "|"), "짧다"),
        (T.policy_name(L("제목"), L("본문의 「특금법 시행령」 개정")), "특금법 시행령"),
        (T.policy_name(L("금융위, 새 방안 공개 - 부제"), L("")), "새 방안 공개"),
        (F.array_join(T.bullets(L("① 전자금융 정산자금 외부관리를 의무화한다 ② 간편결제 한도를 상향 조정한다"), L(""), L("")), "|"), "전자금융 정산자금 외부관리를 의무화한다|간편결제 한도를 상향 조정한다"),
        (F.array_join(T.key_sentences(L("또한 금융위는 가상자산 사업자 규제를 강화한다. 그는 \"매우 어려운 시기라고 본다\"고 말했다. 금융위는 가상자산 시장 감독 체계를 새로 마련한다.")), "|"), "금융위는 가상자산 사업자 규제를 강화한다.|금융위는 가상자산 시장 감독 체계를 새로 마련한다."),
        (T.stage_from_title(L("개정안 국무회의 의결")), "국무회의"),
        (T.press_title(L("x\n◆ 기관 | 「정책/이름」")), "정책이름"),
        (F.array_join(F.transform(T.markers(L("[3] [1] [3][99]"), r"\[(\d+)\]", 20), lambda n: n.cast("string")), ","), "1,3"),
        (T.agency_rank(L("")), 0),  # an empty agency is contained in every name
        (T.agency_rank(L("한국경제TV")), 5),
        (T.agency_rank(L("모름")), 30),
        (ids.source_label(L("PREC")), "판례(법원)"),
        (ids.source_label(L(None).cast("string")), "사례"),
        (ids.article_number(L("제3조의2")), 3),  # branch numbers are lost
        (ids.article_number(L("부칙")), 0),
        (ids.absolute_url(L("/DRF/x"), "https://h"), "https://h/DRF/x"),
        (ids.url_parameter(L("http://a/b?nttId=7&x=1"), "nttId"), "7"),
        (ids.blocked_host(L("https://n.news.naver.com/a"), ("naver.com",)), True),
        (ids.percent(L(1), L(8)), 12.5),
        (F.array_join(ids.json_array(L("bad")), ","), ""),
        (T.json_from_text(L('text ```json\n{"a": 1}\n``` more'), "a int").getField("a"), 1),
        (T.json_from_text(L("no json"), "a int").getField("a"), None),
        (C.priority_grade(L("개인정보보호법"), L("")), "상"),  # a name that is an alias too counts twice
        (C.priority_grade(L("간담회 방문"), L("")), "하"),
        (C.priority_grade(L("시행령"), L("간담회")), "중"),
        (C.target_law(L("특금법과 특정금융정보법"), L("")), "특정 금융거래정보의 보고 및 이용 등에 관한 법률"),
        (C.target_law(L("외환법, 신용정보의 이용 및 보호"), L("")), "신용정보의 이용 및 보호에 관한 법률"),
        (C.is_overseas(L("미국 규제"), L("국내 외 사업자")), True),  # 국내 외 is no home context
        (C.is_overseas(L("미국 규제"), L("국내 사업자")), False),
        (C.attachment_only(L("첨부 자료를 참고")), True),
        (C.category_of(L("가상자산 결제")), "페이먼트"),
    ]


def test_values(spark):
    made = cases()
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(made))).first()
    wrong = [(i, row[i], want) for i, (_, want) in enumerate(made) if row[i] != want]
    assert not wrong


def test_recent_keeps_what_has_no_date(value):
    as_of = L("2026-04-10").cast("date")
    assert [value(dates.is_recent(L(x), as_of)) for x in ("2026-04-07", "2026-04-06", "", "2026.13.01", "2027-01-01")] == [True, False, True, True, True]


def test_key_issues(value):
    issues, rest = T.key_issues(L("앞 [1]\nKEY_ISSUES:\n• 쟁점 하나\n- 쟁점 둘\n\n본문 [2]"))
    assert value(F.array_join(issues, "|")) == "쟁점 하나|쟁점 둘"
    assert value(rest) == "앞 [1]\n본문 [2]"


def test_risk_records(spark):
    rows = [(1, "특금법 개정안 입법예고", "금융위는 가상자산 사업자에 대한 시행령 개정안을 의결했다. 자금세탁을 막기 위한 제도이다."), (2, "뉴스브리핑 코인", "가상자산"), (3, "날씨", None)]
    got = {r.ord: r for r in C.risk_records(spark.createDataFrame(rows, "ord long, title string, body string")).collect()}
    assert got[1].risk_type == "규제" and got[1].risk_grade == "상" and got[1].impacted_areas == ["AML/KYC", "가상자산"]
    assert got[1].recommended_action == "AML/KYC, 가상자산 솔루션 영향도 검토 및 고객사 안내" and got[1].source_of_risk == "rule"
    assert got[2].risk_grade == got[3].risk_grade == "무관" and got[2].summary == "" and got[2].source_of_risk == "pre-gate"


def test_normalise_risk(spark):
    schema = "ord long, policy_name string, summary string, future_plan string, risk_grade string, risk_type string, impacted_areas array<string>, key_changes array<string>, key_points array<string>, recommended_action string"
    rows = [(1, " 「가」 ", "요약 문장 하나다.", None, " 상 ", "모름", [" AML "], ["요약 문장 하나다.", "그는 라고 말했다", "둘", "셋", "넷", "다섯", "여섯"], None, "점검한다."), (2, None, None, None, "상", "규제", [], None, ["점"], "조치")]
    got = {r.ord: r for r in C.normalise_risk(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].risk_grade == "상" and got[1].risk_type == "무관" and got[1].key_changes == ["둘", "셋", "넷", "다섯"] and got[1].recommended_action == "점검"
    assert got[2].risk_grade == "무관" and got[2].recommended_action == "" and got[2].key_points == ["점"]


def test_strip_trims_every_unicode_blank_by_the_built_in_trim(spark):
    from regscope.functions.register import register

    register(spark)
    blanks = T.BLANKS
    assert len(set(blanks)) == 25
    rows = spark.createDataFrame([(f"{blanks}a{blanks}​b\x1f{blanks}",), (blanks,), ("",), (None,)], "x string")
    old = F.regexp_replace(T.nz(F.col("x")), r"(?U)^\s+|\s+$", "")
    got = rows.select(T.strip(F.col("x")).alias("new"), old.alias("old"), F.expr("strip_text(x)").alias("named")).collect()
    assert [tuple(r) for r in got] == [(f"a{blanks}​b\x1f",) * 3, ("",) * 3, ("",) * 3, ("",) * 3]
    assert "regexp" not in str(T.strip(F.col("x"))).lower()


def test_text_rules_search_only_texts_with_their_signs(spark, monkeypatch):
    import random

    r = random.Random(3)
    ends = ["나오고 있다", "나왔다.", "보인다", "커지고　있어요", "증가하고있다.", "줄어들고 있", "있다", "없다.", "전망이다", "막이다", "이다", "입니다.", "됐다", "되었습니다.", "된다", "했다했다.", "하였다", "합니다 ", "하다..", "다", "라", "다... ", "한다.\n", "한다.\x85"]
    signs = [*'"“”\'‘’[]()「』.…—–,?! 　\n가a', "—", " – ", "..", "[단독]", "라고 말했다"]
    texts = [w + e for w in ("", "가", "나 라", "강화 ", "있다 ") for e in ends] + ["".join(r.choice(signs) for _ in range(r.randrange(0, 14))) for _ in range(600)] + [None]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    s = F.regexp_replace(T.strip(F.col("x")), r"(?U)\.{2,}\s*$", "")
    for rule, to in reversed(T.D.NOUN_ENDINGS):
        made = F.regexp_replace(s, T.U + rule, to)
        later = made if rule == T.D.NOUN_ENDINGS[-1][0] else F.when(made != s, made).otherwise(later)
    noun = T.strip(F.regexp_replace(later, r"(?U)[,.\s]+$", ""))
    b = T.strip(F.col("x"))
    for pattern in ('"[^"]*"', "“[^”]*”", "'[^']*'", "‘[^’]*’", r"\[[^\]]{1,20}\]", r"(?U)\s*\[[^\]]*$"):
        b = F.regexp_replace(b, pattern, " ")
    rows = rows.withColumn("b", b)
    b = F.when(F.regexp_count("b", F.lit(r"\]")) > F.regexp_count("b", F.lit(r"\[")), F.regexp_replace("b", r"(?U)^\s*[^\[]*\]\s*", " ")).otherwise(F.col("b"))
    for pattern, to in ((r"(?U)\s*\([^)]*$", " "), ("[「」『』]", ""), (r"\.{2,}", " "), ("…+", " "), ("[\"“”'‘’]", "")):
        b = F.regexp_replace(b, pattern, to)
    for pattern, to in ((r"(?U)\s{2,}", " "), (r"(?U)\s+([,.?!])", "$1"), (r"(?U)^[,.\s]+|[,.\s]+$", "")):
        b = F.regexp_replace(F.element_at(F.split(b, r"(?U)\s+[—–]\s+"), 1) if to == " " else b, pattern, to)
    for x in rows.select("x", T.noun_ending(F.col("x")).alias("noun"), noun.alias("old"), T.strip_brackets(F.col("x")).alias("bare"), T.strip(b).alias("was")).collect():
        assert (x.noun, x.bare) == (x.old, x.was), repr(x.x)
    # a text without an ending's sign meets no rule: a rule that turns every text would have shown
    everywhere = tuple((sign, r"[\s\S]+", "found") for sign, _, _ in T.ENDINGS)
    monkeypatch.setattr(T, "ENDINGS", everywhere)
    got = spark.createDataFrame([("summary of many words",), ("검토한다",)], "x string").select(T.noun_ending(F.col("x"))).collect()
    assert [x[0] for x in got] == ["summary of many words", "found"]
