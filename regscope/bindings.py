"""Domain tables derived from the driver's tables, the same expressions for Spark and DuckDB.

Each text is SQL that both engines read; ``{name}`` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def pick(expression: str, values: list[str]) -> str:
    """The value at an integer expression's place."""
    return f"CASE {expression} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


TITLES = [
    "특금법 개정안 입법예고 — 가상자산 사업자 규제 강화", "개인정보보호법 시행령 개정, 과태료 상향 추진", "[오늘의 국회일정] 금융위 간담회", "코인 거래소 해킹 사고로 고객 자금 유출",
    "금융위, 전자금융거래법 위반 업체 제재", "美 SEC, 가상자산 클래리티 법안 공개", "기관장 취임 인사와 기념 행사 참석", "보이스피싱 자금세탁 일당 검거… 범죄수익 압수",
    "뉴스브리핑: 비트코인 10만 달러 돌파", "한국판 스테이블코인 도입, 미국 GENIUS Act 참고", "[단독] 마이데이터 전송요구권 확대 시행", "지역 축제 소통 간담회 방문 격려",
]
BODIES = [
    "금융위는 특정금융정보법 시행령 개정안을 의결했다. 가상자산 사업자는 앞으로 트래블룰을 적용받는다. 이를 위반하면 과태료 처분을 받는다.",
    "개인정보 보호법에 따라 유출 사고를 낸 기업은 과징금을 낸다. 또한 전송요구권이 모든 업종으로 확대된다고 한다.",
    "경찰은 자금세탁 조직을 적발했다고 밝혔다. 수사 결과 범죄수익 100억원이 압수됐다. 거래소 계좌 20개가 동결되었다.",
    "미국 재무부와 FATF는 새 기준을 발표했다. 국내 외 사업자 모두 영향을 받을 전망이다.",
    "첨부 자료를 참고해 주시기 바랍니다.",
    "① 전자금융 정산자금 외부관리 의무화를 추진한다 ② 간편결제 한도를 상향한다 ③ 오픈뱅킹 이용 대상을 넓힌다",
    "행사에는 기관장과 임직원이 참석해 인사를 나눴다. 이날 간담회는 홍보를 위한 자리였다.",
]
AGENCIES = ["연합뉴스", "OSEN", "금융위원회", "한겨레", "", "DREAM"]

ARTICLES_KR = f"""
SELECT o_orderkey AS ord, {pick("o_orderkey % 12", TITLES)} || ' ' || CAST(o_orderkey % 40 AS STRING) AS title,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE {pick("(o_orderkey + o_custkey) % 7", BODIES)} || ' ' || o_orderpriority END AS body,
  {pick("o_custkey % 6", AGENCIES)} AS agency, CAST(CAST(o_orderdate AS DATE) AS STRING) AS pub_date,
  CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'https://news.example/a/' || CAST(o_orderkey % 9000 AS STRING) END AS link
FROM {{orders}}"""

ARTICLES_TXT = """
SELECT doc_id AS ord, split_part(text, chr(10), 1) AS title, text AS body, source AS agency, 'doc/' || CAST(doc_id % 700 AS STRING) AS link,
  CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS STRING) AS pub_date
FROM {documents}"""

ACTS = """
SELECT 'a' || CAST(p_partkey AS STRING) AS id, CAST(p_partkey AS INT) AS jo_no, CAST(p_partkey AS INT) AS order_idx, 'act' AS law_type, 'L1' AS law_id, '금융거래법' AS law_name,
  '제' || CAST(p_partkey AS STRING) || '조' AS jo_label,
  CASE WHEN p_partkey % 25 = 0 THEN '' ELSE p_name END AS jo_title,
  CASE WHEN p_partkey % 25 = 0 THEN '제' || CAST(p_partkey / 25 AS INT) || '장 ' || p_type || ' <개정>' ELSE p_brand || '에 관한 사항은 대통령령으로 정한다. ① 첫 항 ② 둘째 항' END AS body
FROM {part}"""

DECREES = """
SELECT 'e' || CAST(s_suppkey AS STRING) AS id, CAST(s_suppkey AS INT) AS jo_no, CAST(s_suppkey AS INT) AS order_idx, 'enforce' AS law_type, 'L1-E' AS law_id, '금융거래법 시행령' AS law_name,
  '제' || CAST(s_suppkey AS STRING) || '조' AS jo_label, s_name AS jo_title,
  CASE WHEN s_suppkey % 2 = 0 THEN '같은 법 제' || CAST(s_suppkey + s_nationkey AS STRING) || '조에 따른 기준' ELSE '세부 기준을 둔다' END AS body
FROM {supplier}"""

RULES = """
SELECT 'r' || CAST(l_orderkey AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS id, CAST(l_orderkey AS INT) AS jo_no, CAST(l_orderkey AS INT) AS order_idx, 'regulation' AS law_type, 'L1-R' AS law_id, '금융거래 감독규정' AS law_name,
  '제' || CAST(l_orderkey AS STRING) || '조' AS jo_label, l_returnflag AS jo_title,
  CASE l_partkey % 3 WHEN 0 THEN '법 제' || CAST(l_partkey AS STRING) || '조에 따라 정한다' WHEN 1 THEN '영 제' || CAST(l_suppkey AS STRING) || '조의 세부 사항' ELSE '관계법 제7조와 같다 ' || CAST(l_partkey % 997 AS STRING) END AS body
FROM {lineitem}"""

BILLS = f"""
SELECT o_orderkey AS ord, {pick("o_orderkey % 5", ["특금법", "가상자산", "개인정보", "전자금융", "보이스피싱"])} AS target_law, 'bill ' || CAST(o_orderkey % 300 AS STRING) AS bill_title,
  CASE o_orderkey % 4 WHEN 0 THEN '공포 (' || CAST(year(o_orderdate) AS STRING) || '. ' || CAST(month(o_orderdate) AS STRING) || '. ' || CAST(day(o_orderdate) AS STRING) || '.)' WHEN 1 THEN '국무회의 의결' WHEN 2 THEN '위원회 심사' ELSE '본회의 가결' END AS status,
  CASE o_orderkey % 3 WHEN 0 THEN CAST(year(o_orderdate) AS STRING) || '. ' || CAST(month(o_orderdate) AS STRING) || '. ' || CAST(day(o_orderdate) AS STRING) || '.' WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) ELSE '' END AS propose_date
FROM {{orders}}"""

STREAM_ROWS = """
SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, 'u/' || CAST(user_id AS STRING) || '/' || event_type AS url, event_type AS category, value FROM {events}"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = {n: table(spark, sf_dir, n) for n in TABLES if f"{{{n}}}" in text}
    return spark.sql(text, **used)


def duck(text: str) -> str:
    for n in TABLES:
        text = text.replace(f"{{{n}}}", n)
    return text
