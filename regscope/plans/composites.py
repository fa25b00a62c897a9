"""Composite queries: what a user of the monitor calls, chained from the operators; registered when the catalog is read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regscope import bindings as B
from regscope import catalog as K
from regscope.functions import dates, ids
from regscope.functions import dicts as D
from regscope.functions import text as T
from regscope.operators import classify as C
from regscope.operators import crosswalk as X
from regscope.operators import cosine, digest, firstwins, joins, layout, quality, search, simjoin, tables
from regscope.sources import html

AS_OF = "1997-03-14"


def daily_monitor(articles: DataFrame, as_of: str, days: int = 2, exclude_self: bool = True, **rule: object) -> DataFrame:
    """Articles of the last days that are graded 상 and no noise, first of each link and title, unlike yesterday's, one of
    each similar group, home before overseas.

    Yesterday's rows are candidates and reference at once, so each removes itself; without ``exclude_self`` only rows of
    ``as_of`` are held against yesterday's.
    """
    title, body = F.col("title"), F.col("body")
    recent = articles.where(C.date_window(F.col("pub_date"), as_of, days))
    fit = recent.where((C.priority_grade(title, body) == "상") & ~C.is_noise(title, body, F.col("agency")))
    fit = tables.checkpointed(firstwins.first_wins_multi(fit))
    before = F.date_sub(F.lit(as_of).cast("date"), 1).cast("string")
    yesterday = fit.where(F.substring("pub_date", 1, 10) == before)
    fresh = fit if exclude_self else fit.where(F.substring("pub_date", 1, 10) == as_of)
    kept = tables.checkpointed(simjoin.drop_similar(fresh, yesterday, **rule))
    if not exclude_self:
        kept = kept.unionByName(yesterday)
    groups = simjoin.leader_groups(kept, **rule)
    best = firstwins.representatives(kept.join(groups, "ord"), "leader")
    return best.withColumn("overseas", C.is_overseas(title, body)).drop("leader")


def all_titles(articles: DataFrame, as_of: str, days: int, exclude: DataFrame, vectors: DataFrame | None = None, cut: float = D.VECTOR_SIMILAR, **rule: object) -> DataFrame:
    """All no-noise titles of the days apart from ``exclude`` and what is similar to it, one of each similar group.

    With ``vectors`` (``ord, embedding``) of all titles similarity is their cosine, else that of their token sets.
    """
    recent = articles.where(C.date_window(F.col("pub_date"), as_of, days) & ~C.is_noise(F.col("title"), F.col("body"), F.col("agency")))
    first = tables.checkpointed(firstwins.first_wins_multi(recent))
    if vectors is not None and first.unionByName(exclude.select(*first.columns)).join(vectors, "ord", "left_anti").isEmpty():
        held = tables.checkpointed(first.join(vectors, "ord"))
        rest = tables.checkpointed(cosine.embedding_exclude(held, exclude.select("ord").join(vectors, "ord"), cut, "ord"))
        groups = cosine.vector_groups(rest, cut, "ord")
        rest = rest.drop("embedding")
    else:
        rest = tables.checkpointed(simjoin.drop_similar(first, exclude, **rule))
        groups = simjoin.leader_groups(rest, **rule)
    return firstwins.representatives(rest.join(groups, "ord"), "leader").drop("leader")


def _tokens_sql(text: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all({text}, '[가-힣]{{2,}}')), lambda w: NOT list_contains([{', '.join(map(K.s, D.MONITOR_STOP))}], w))"


def _similar_sql(x: str, y: str) -> str:
    one = lambda t, cut: f"(len({x}.{t}) > 0 AND len({y}.{t}) > 0 AND len(list_intersect({x}.{t}, {y}.{t})) / (len({x}.{t}) + len({y}.{t}) - len(list_intersect({x}.{t}, {y}.{t}))) >= {cut})"
    return f"({one('tt', 0.6)} OR {one('tb', 0.55)})"


def _first_wins_sql(rows: str, out: str) -> str:
    """Rows of ``rows`` of which neither link nor title stood on an earlier kept one, with their token sets."""
    return rf"""
{out}_r AS MATERIALIZED (SELECT ord, coalesce(link, '') AS l, regexp_replace(coalesce(title, ''), '\s+', '', 'g') AS t, row_number() OVER (ORDER BY ord) AS n FROM {rows}),
{out}_g AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS ls, []::VARCHAR[] AS ts, NULL::BIGINT AS kept
UNION ALL SELECT n, CASE WHEN c THEN list_append(ls, l) ELSE ls END, CASE WHEN c THEN list_append(ts, t) ELSE ts END, CASE WHEN c THEN ord END
FROM (SELECT r.n, g.ls, g.ts, r.ord, r.l, r.t, (l = '' OR NOT list_contains(ls, l)) AND (t = '' OR NOT list_contains(ts, t)) AS c FROM {out}_g g JOIN {out}_r r ON r.n = g.n + 1)),
{out} AS MATERIALIZED (SELECT *, {_tokens_sql("coalesce(title, '')")} AS tt, {_tokens_sql("coalesce(title, '') || ' ' || substr(coalesce(body, ''), 1, 1200)")} AS tb FROM {rows} WHERE ord IN (SELECT kept FROM {out}_g))"""


def _grouped_sql(kept: str, out: str, edge: str) -> str:
    """The representative of each leader group of ``kept``."""
    leaders = K.LEADER_SQL
    for name in ("bn", "g", "lead", "nodes", "edges"):
        leaders = re.sub(rf"\b{name}\b", f"{out}_{name}", leaders)
    return f"""
{out}_nodes AS MATERIALIZED (SELECT ord FROM {kept}), {out}_edges AS MATERIALIZED (SELECT x.ord AS a, y.ord AS b FROM {kept} x JOIN {kept} y ON x.ord < y.ord AND {edge}), {leaders},
{out} AS MATERIALIZED (SELECT * EXCLUDE (q) FROM (SELECT k.*, row_number() OVER (PARTITION BY leader ORDER BY -length(coalesce(body, '')), {K.RANK_SQL}, k.ord) AS q FROM {kept} k JOIN {out}_lead USING (ord)) WHERE q = 1)"""


WINDOW_SQL = f"SELECT * FROM {K.KR} WHERE pub_date BETWEEN '1997-02-13' AND '{AS_OF}' AND NOT {K.NOISE_SQL}"
MONITOR_SQL = f"""
WITH RECURSIVE fine AS MATERIALIZED (SELECT * FROM ({WINDOW_SQL}) WHERE {K.GRADE} = '상'), {_first_wins_sql('fine', 'fit')},
before AS MATERIALIZED (SELECT * FROM fit WHERE pub_date = '1997-03-13'),
kept AS MATERIALIZED (SELECT * FROM fit f WHERE pub_date = '{AS_OF}' AND NOT EXISTS (SELECT 1 FROM before y WHERE {_similar_sql('f', 'y')} OR (trim(f.link) <> '' AND f.link = y.link)) UNION ALL SELECT * FROM before),
{_grouped_sql('kept', 'best', _similar_sql('x', 'y'))}"""
TITLES_SQL = f"""{MONITOR_SQL}, listed AS MATERIALIZED ({WINDOW_SQL}), {_first_wins_sql('listed', 'once')},
rest AS MATERIALIZED (SELECT * FROM once f WHERE NOT EXISTS (SELECT 1 FROM best y WHERE {_similar_sql('f', 'y')} OR (trim(f.link) <> '' AND f.link = y.link))),
{_grouped_sql('rest', 'titles', _similar_sql('x', 'y'))}"""
VECTORS = "SELECT a.ord, e.embedding FROM (SELECT o_orderkey AS ord, c FROM {orders} CROSS JOIN (SELECT count(*) AS c FROM {embeddings})) a JOIN {embeddings} e ON e.vec_id = a.ord % a.c"
TITLES_BY_VECTOR_SQL = f"""{MONITOR_SQL}, listed AS MATERIALIZED ({WINDOW_SQL}), {_first_wins_sql('listed', 'once')},
vec AS MATERIALIZED ({VECTORS}), far AS MATERIALIZED (SELECT x.*, v.embedding FROM once x JOIN vec v USING (ord)), gone AS MATERIALIZED (SELECT v.embedding FROM best JOIN vec v USING (ord)),
rest AS MATERIALIZED (SELECT * FROM far x WHERE NOT EXISTS (SELECT 1 FROM gone y WHERE {K.COS_SQL} >= 0.3)),
{_grouped_sql('rest', 'titles', f"{K.COS_SQL} >= 0.3")}"""


@K.query(f"{MONITOR_SQL} SELECT ord, title, {K.OVERSEAS_SQL} AS overseas, pub_date FROM best")
def q1_daily_monitor(spark: SparkSession, d: str) -> DataFrame:
    found = daily_monitor(K.kr(spark, d), AS_OF, 30, exclude_self=False)
    return digest.sort_home_first(found, F.col("overseas")).select("ord", "title", "overseas", "pub_date")


@K.query(f"{TITLES_SQL} SELECT ord, title, pub_date FROM titles")
def q2_all_titles(spark: SparkSession, d: str) -> DataFrame:
    first = tables.checkpointed(daily_monitor(K.kr(spark, d), AS_OF, 30, exclude_self=False))
    return digest.sort_date_desc(all_titles(K.kr(spark, d), AS_OF, 30, first)).select("ord", "title", "pub_date")


@K.query(f"{TITLES_BY_VECTOR_SQL} SELECT ord, title, pub_date FROM titles")
def q2_all_titles_vectors(spark: SparkSession, d: str) -> DataFrame:
    """As above by the vectors of the titles, which are an input table."""
    first = tables.checkpointed(daily_monitor(K.kr(spark, d), AS_OF, 30, exclude_self=False))
    found = all_titles(K.kr(spark, d), AS_OF, 30, first, tables.checkpointed(B.view(spark, d, VECTORS)), 0.3)
    return digest.sort_date_desc(found).select("ord", "title", "pub_date")


def risk_digest(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The digest's rows, and the sent log after it: rows unsent and recent, first of each address, graded, capped."""
    rows = K.kr(spark, d)
    sent = rows.where("ord % 11 = 0 AND link <> ''").groupBy(F.col("link").alias("url")).agg(F.lit(None).cast("string").alias("risk_grade"))
    fresh = joins.unsent(rows, sent.withColumnRenamed("url", "link"), "link").where(dates.is_recent(F.col("pub_date"), F.lit("1998-07-31").cast("date")))
    found = digest.sort_grade_cap(C.risk_records(firstwins.first_wins(fresh, "link")))
    return found, tables.insert_ignore(sent, found.select(F.col("link").alias("url"), "risk_grade"), "url")


FRESH_SQL = f"""sent AS (SELECT DISTINCT link AS url FROM {K.KR} WHERE ord % 11 = 0 AND link <> ''),
fresh AS MATERIALIZED (SELECT * FROM {K.KR} WHERE ord IN (SELECT min(ord) FROM {K.KR} WHERE coalesce(link, '') <> '' AND link NOT IN (SELECT url FROM sent) AND date_diff('day', CAST(pub_date AS DATE), DATE '1998-07-31') <= 3 GROUP BY link))"""


@K.query(f"WITH {FRESH_SQL}, {K._risk_records_sql('fresh a')} SELECT ord, risk_grade, risk_type, areas, policy_name, summary, key_changes, recommended_action FROM rr WHERE risk_grade IN ('상', '중') ORDER BY CASE risk_grade WHEN '상' THEN 0 ELSE 1 END, ord LIMIT 10")
def q3_risk_digest(spark: SparkSession, d: str) -> DataFrame:
    return risk_digest(spark, d)[0].select("ord", "risk_grade", "risk_type", F.array_join("impacted_areas", ",").alias("areas"), "policy_name", "summary", F.array_join("key_changes", "|").alias("key_changes"), "recommended_action")


@K.query(f"""
WITH sent AS (SELECT DISTINCT link AS url FROM {K.KR} WHERE ord % 11 = 0 AND link <> ''),
fresh AS (SELECT min(ord) AS ord, link FROM {K.KR} WHERE coalesce(link, '') <> '' AND link NOT IN (SELECT url FROM sent) AND date_diff('day', CAST(pub_date AS DATE), DATE '1998-07-31') <= 3 GROUP BY link),
graded AS (SELECT ord, {K.RULE_GRADE_SQL} AS risk_grade FROM ({K.RISK_SQL}) WHERE {K.RELEVANT_SQL}),
post AS (SELECT link, risk_grade FROM fresh JOIN graded USING (ord) WHERE risk_grade IN ('상', '중') ORDER BY CASE risk_grade WHEN '상' THEN 0 ELSE 1 END, ord LIMIT 10)
SELECT url, NULL AS risk_grade FROM sent UNION ALL SELECT link, risk_grade FROM post""")
def q3_sent_log(spark: SparkSession, d: str) -> DataFrame:
    return risk_digest(spark, d)[1]


@K.query(f"""
WITH u AS (SELECT 'd' || CAST(doc_id AS STRING) AS id, text AS body, source, lang AS law_id, 'the ' || lang || ' law' AS law_name FROM {{documents}} UNION ALL SELECT 'b' || CAST(item_id AS STRING), text, 'bench', 'en', 'the en law' FROM {{benchmark}}),
f AS (SELECT * FROM u WHERE source IN ('src1', 'src2', 'src3', 'bench') AND law_id IN ('en', 'de') AND contains(replace(law_name, ' ', ''), 'enlaw')),
k AS (SELECT id, body, list_distinct(regexp_extract_all(lower(body), '{K.WORD}')) AS k FROM f), sc AS (SELECT id, body, len(list_intersect(k, [{K.QUESTION_SQL}])) AS i, len(k) AS n FROM k)
SELECT id, score, {K._summary_sql('body', 200)} AS head FROM (SELECT id, body, round(i / (n + {len(K.QUESTION.split())} - i), 6) AS score FROM sc WHERE i > 0 ORDER BY i / (n + {len(K.QUESTION.split())} - i) DESC, id LIMIT 50)""".replace("{{3,}}", "{3,}"))
def q4_unified_search(spark: SparkSession, d: str) -> DataFrame:
    """Two corpora under one schema, restricted by source, law and the law's name; the best 50 with their texts cleaned and cut at a sentence."""
    docs = K.t(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("body"), "source", F.col("lang").alias("law_id"))
    bench = K.t(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("body"), F.lit("en").alias("law_id"))
    rows = C.allowed_sources(search.union_corpora(docs, bench, {"source": "bench"}), ["src1", "src2", "src3", "bench"])
    rows = rows.withColumn("law_name", F.concat(F.lit("the "), "law_id", F.lit(" law")))
    rows = joins.restrict(rows, spark.createDataFrame([("en",), ("de",)], "law_id string"), "law_id")
    rows = joins.name_contains(rows, "law_name", ["en law"])
    found = search.search(rows, K.QUESTION, 50, "id", F.lower("body"), K.WORD)
    return found.select("id", F.round("score", 6).alias("score"), T.normalize_summary(F.col("body"), 200).alias("head"))


@K.query(rf"""
WITH {K.RANKED_SQL}, o AS (SELECT conv_id, sha1('v3:' || lower(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g')) || ':L1') AS cache_key FROM {{conversations}} WHERE turn = 0 AND role = 'user'),
a AS (SELECT * FROM o WHERE conv_id % 10 = 0),
h AS (SELECT coalesce(x.cache_key, y.cache_key) AS cache_key, coalesce(x.n, 0) + coalesce(y.n, 0) AS hit_count FROM (SELECT cache_key, count(*) AS n FROM o WHERE conv_id % 20 = 0 GROUP BY 1) x FULL JOIN (SELECT cache_key, count(*) AS n FROM a GROUP BY 1) y ON x.cache_key = y.cache_key),
c AS (SELECT conv_id, count(*) AS n_blocks, {K.CONTEXT_SQL} AS context, string_agg(CASE WHEN rank IN (1, 3) THEN CAST(doc_id AS STRING) END, ',' ORDER BY rank) AS cited FROM rk JOIN {{documents}} USING (doc_id) WHERE rank <= 20 GROUP BY conv_id)
SELECT conv_id, a.cache_key, hit_count, n_blocks, sha1(context) AS context_sha1, cited FROM a JOIN h USING (cache_key) JOIN c USING (conv_id)""")
def q5_ask_context(spark: SparkSession, d: str) -> DataFrame:
    """Of every tenth conversation's opening question (the query set): its cache key and hits, its context of the best 20
    documents, and what the answer's markers cite. Half of the questions are cached before; answers are stored, as none is
    asked for here."""
    opening = K.t(spark, d, "conversations").where("turn = 0 AND role = 'user'").select("conv_id", F.col("text").alias("question"), F.array(F.lit("L1")).alias("laws"))
    asked = opening.where("conv_id % 10 = 0")
    blank = spark.createDataFrame([], "cache_key string, question string, law_ids string, hit_count long, updated_at timestamp")
    cache = search.cache_lookup(opening.where("conv_id % 20 = 0"), blank, F.lit("2024-01-01").cast("timestamp"))
    cache = search.cache_lookup(asked, cache, F.lit("2024-02-01").cast("timestamp")).select("cache_key", "hit_count")
    keyed = asked.select("conv_id", ids.cache_key(F.col("question"), F.col("laws")).alias("cache_key")).join(cache, "cache_key")
    ranked = tables.checkpointed(K.ranked_candidates(spark, d, 20))
    docs = K.txt(spark, d).withColumnRenamed("ord", "doc_id")
    contexts = search.context_blocks(ranked.join(docs.select("doc_id", "title", "agency", "body"), "doc_id"), "conv_id")
    answers = asked.select("conv_id", F.lit("see [1], [99] and [3][1]").alias("answer"))
    cited = search.resolve_citations(answers, ranked.select("conv_id", "doc_id", "rank"), "conv_id")
    marks = F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col("doc_id").cast("string").alias("id")))), lambda x: x["id"])
    cited = cited.groupBy("conv_id").agg(F.array_join(marks, ",").alias("cited"))
    return keyed.join(contexts, "conv_id").join(cited, "conv_id", "left").select("conv_id", "cache_key", "hit_count", "n_blocks", F.sha1("context").alias("context_sha1"), "cited")


def _top_sql(items: str, key: str, k: int) -> str:
    return f"""(SELECT q, {key}, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, {key}) AS INT) AS rank FROM (
SELECT q, {key}, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS score FROM (SELECT q, unnest(k) AS w, len(k) AS n FROM asked) a JOIN (SELECT {key}, unnest(k) AS w, len(k) AS n FROM {items}) b USING (w) GROUP BY q, {key}) QUALIFY rank <= {k})"""


@K.query(rf"""
WITH asked AS (SELECT doc_id AS q, list_distinct(regexp_extract_all(lower(text), '{K.WORD}')) AS k FROM {{documents}} WHERE doc_id % 100 = 0),
cs AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '{K.WORD}')) AS k FROM {{documents}} WHERE doc_id % 100 <> 0), ls AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '{K.WORD}')) AS k FROM {{benchmark}}),
c AS (SELECT q, string_agg(CAST(doc_id AS STRING), ',' ORDER BY rank) AS cases, max(CASE WHEN rank = 1 THEN doc_id END) AS first_case FROM {_top_sql('cs', 'doc_id', 15)} GROUP BY q),
o AS (SELECT doc_id AS q, sha1('v3:' || lower(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g')) || ':L1') AS cache_key FROM {{documents}} WHERE doc_id % 100 = 0),
h AS (SELECT cache_key, count(*) + count(*) FILTER (q % 200 = 0) AS hit_count FROM o GROUP BY 1),
x AS (SELECT q, count(*) AS n_blocks, sha1({K.CONTEXT_SQL}) AS context_sha1 FROM {_top_sql('cs', 'doc_id', 15)} JOIN {{documents}} USING (doc_id) GROUP BY q),
l AS (SELECT q, string_agg(CAST(item_id AS STRING), ',' ORDER BY rank) AS laws, max(CASE WHEN rank = 2 THEN item_id END) AS second_law FROM {_top_sql('ls', 'item_id', 10)} GROUP BY q)
SELECT q AS request, cases, laws, 'issue ' || CAST(q AS STRING) || '|two' AS issues, first_case, second_law, cache_key, hit_count, n_blocks, context_sha1 FROM asked JOIN o USING (q) JOIN h USING (cache_key) LEFT JOIN c USING (q) LEFT JOIN l USING (q) LEFT JOIN x USING (q)""")
def q6_analyze_document(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose id is divisible by 100 (the query set): cache key and hits, the cases (15) and statutes (10) nearest to
    them, the context of the cases, and the key issues and citations of their answers. Half of the requests are cached before. Answers are stored; here they are made up from the request, as no model is called."""
    docs, laws = K.t(spark, d, "documents").select("doc_id", "text"), K.t(spark, d, "benchmark").select("item_id", "text")
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("request"), "text")
    own = T.tokens(F.lower("text"), K.WORD, ())
    cases = tables.checkpointed(search.top_matches(docs.where("doc_id % 100 <> 0"), asked, "doc_id", "request", own, own, 15))
    statutes = tables.checkpointed(search.top_matches(laws, asked, "item_id", "request", own, own, 10))
    text = F.format_string("KEY_ISSUES:\n• issue %d\n- two\n\nsee [1] and [L2][L99]", F.col("request"))
    answers = asked.select("request", text.alias("answer"))
    issues, rest = T.key_issues(F.col("answer"))
    answers = tables.checkpointed(answers.select("request", F.array_join(issues, "|").alias("issues"), rest.alias("answer")))
    first = search.resolve_citations(answers, cases, "request", 15).select("request", F.col("doc_id").alias("first_case"))
    second = search.resolve_citations(answers, statutes, "request", 10, r"\[L(\d+)\]").select("request", F.col("item_id").alias("second_law"))

    def listed(rows: DataFrame, key: str, name: str) -> DataFrame:
        found = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(key).cast("string").alias("id")))), lambda x: x["id"])
        return rows.groupBy("request").agg(F.array_join(found, ",").alias(name))

    keyed = asked.select("request", F.col("text").alias("question"), F.array(F.lit("L1")).alias("laws"))
    blank = spark.createDataFrame([], "cache_key string, question string, law_ids string, hit_count long, updated_at timestamp")
    cache = search.cache_lookup(keyed.where("request % 200 = 0"), blank, F.lit("2024-01-01").cast("timestamp"))
    cache = search.cache_lookup(keyed, cache, F.lit("2024-02-01").cast("timestamp")).select("cache_key", "hit_count")
    keys = keyed.select("request", ids.cache_key(F.col("question"), F.col("laws")).alias("cache_key")).join(cache, "cache_key")
    texts = K.txt(spark, d).withColumnRenamed("ord", "doc_id").select("doc_id", "title", "agency", "body")
    contexts = search.context_blocks(cases.join(texts, "doc_id"), "request", 15).select("request", "n_blocks", F.sha1("context").alias("context_sha1"))
    out = asked.select("request")
    for side in (keys, listed(cases, "doc_id", "cases"), listed(statutes, "item_id", "laws"), answers.select("request", "issues"), first, second, contexts):
        out = out.join(side, "request", "left")
    return out


CELLS = f"""{K.CROSS_SQL}, f AS (SELECT side, act_no, y.* FROM x JOIN (SELECT id, order_idx, jo_label FROM ({B.DECREES}) UNION ALL SELECT id, order_idx, jo_label FROM ({B.RULES})) y USING (id) WHERE act_no IS NOT NULL),
cell AS (SELECT side, act_no, string_agg(jo_label, ' / ' ORDER BY order_idx, id) AS label FROM f GROUP BY side, act_no)"""


@K.query(f"{CELLS} SELECT a.id, CASE WHEN jo_title = '' THEN 'chapter' ELSE 'article' END AS type, e.label AS enforce, g.label AS regulation FROM ({B.ACTS}) a LEFT JOIN cell e ON jo_title <> '' AND e.side = 'enforce' AND e.act_no = a.jo_no LEFT JOIN cell g ON jo_title <> '' AND g.side = 'regulation' AND g.act_no = a.jo_no")
def q7_law_comparison(spark: SparkSession, d: str) -> DataFrame:
    acts = X.law_lookup(B.view(spark, d, B.ACTS), "금융거래법")
    rows = X.comparison(acts, K.no_refs(B.view(spark, d, B.DECREES)), K.no_refs(B.view(spark, d, B.RULES)))
    return rows.select("id", "type", F.col("enforce.label").alias("enforce"), F.col("regulation.label").alias("regulation"))


@K.query("SELECT event_type, count(*) AS total, CAST(max(CAST(ts AS DATE)) AS STRING) AS last_day FROM {events} GROUP BY 1")
def q15_status_board(spark: SparkSession, d: str) -> DataFrame:
    found = quality.category_counts(K.t(spark, d, "events"), "event_type", F.col("ts").cast("date"), "2024-01-15")
    return found.select("event_type", "total", F.col("last_day").cast("string").alias("last_day"))


LIST_PAGES = """
SELECT CAST(o_orderkey / 40 AS BIGINT) AS page_id, '<html><table><tr><th>law</th><th>title</th><th>date</th></tr>' || array_join(array_sort(collect_list('<tr><td>' || target_law || '</td><td><a href="l/' || lpad(CAST(ord AS STRING), 12, '0') || '">' || bill_title || '</a></td><td>' || propose_date || '</td></tr>')), '') || '</table></html>' AS html
FROM (SELECT *, ord AS o_orderkey FROM ({bills})) GROUP BY CAST(o_orderkey / 40 AS BIGINT)"""


@K.query(rf"""
WITH b AS (SELECT lpad(CAST(ord AS STRING), 12, '0') AS no, target_law, bill_title, CASE WHEN regexp_matches(propose_date, '{K.SP}') THEN regexp_extract(propose_date, '{K.SP}', 1) || '.' || lpad(regexp_extract(propose_date, '{K.SP}', 2), 2, '0') || '.' || lpad(regexp_extract(propose_date, '{K.SP}', 3), 2, '0') || '.' ELSE propose_date END AS propose_date, ord FROM ({B.BILLS}))
SELECT substr(md5('l/' || no), 1, 12) AS id, 'https://law.example/l/' || no AS link, target_law, bill_title, propose_date, CASE WHEN ord % 3 = 0 THEN 'kept' WHEN ord % 5 = 0 THEN 'local' ELSE '' END AS summary FROM b
UNION ALL SELECT 'gone', 'https://law.example/l/none', 'old', 'old bill', '', 'kept'""")
def q9_legislation_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Bills from list pages: table rows, dates and addresses brought to form, old enrichment kept (the store's before the
    local one), merged by link."""
    pages = B.view(spark, d, LIST_PAGES.replace("{bills}", B.BILLS))
    rows = html.html_table_rows(pages, min_cells=3).where("href IS NOT NULL")
    link = ids.absolute_url(F.concat(F.lit("/"), F.col("href")), "https://law.example")
    bills = rows.select(ids.short_id(F.col("href")).alias("id"), link.alias("link"), F.col("cells")[0].alias("target_law"), F.col("cells")[1].alias("bill_title"), dates.norm_bill_date(F.col("cells")[2]).alias("propose_date"), F.lit("").alias("summary"))
    bills = tables.checkpointed(bills)
    number = F.regexp_extract("link", r"(\d+)$", 1).cast("long")
    old = bills.where(number % 3 == 0).withColumn("summary", F.lit("kept")).unionByName(spark.range(1).select(F.lit("gone").alias("id"), F.lit("https://law.example/l/none").alias("link"), F.lit("old").alias("target_law"), F.lit("old bill").alias("bill_title"), F.lit("").alias("propose_date"), F.lit("kept").alias("summary")))
    local = bills.where(number % 5 == 0).withColumn("summary", F.lit("local"))
    return tables.upsert(old, tables.preserve_enriched(bills, old, local, "link", ["summary"]), "link")


@K.query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'fresh ' || c_name END AS summary, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'r' END AS reason FROM {customer}")
def q10_bill_detail(spark: SparkSession, d: str) -> DataFrame:
    c = K.t(spark, d, "customer")
    stored = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise("").alias("summary"), F.lit("").alias("reason"))
    parsed = c.select("c_custkey", F.concat(F.lit("fresh "), "c_name").alias("summary"), F.lit("r").alias("reason"))
    return joins.bill_detail(stored, parsed, "c_custkey", ["summary", "reason"])


CASE_LAW_SQL = K._law_sql()


@K.query(f"""
WITH law AS MATERIALIZED ({CASE_LAW_SQL})
SELECT ord, decided_at, target_law, detail FROM (SELECT *, row_number() OVER (PARTITION BY target_law ORDER BY decided_at DESC, ord) AS r FROM (
SELECT ord, replace(pub_date, '-', '.') || '.' AS decided_at, law AS target_law, ord % 2 = 1 OR date_diff('day', CAST(pub_date AS DATE), DATE '1998-08-02') <= 90 AS detail
FROM (SELECT ord, pub_date FROM {K.KR}) JOIN law USING (ord) WHERE law <> '')) WHERE r <= 300""")
def q11_case_load(spark: SparkSession, d: str) -> DataFrame:
    """Cases with normal dates and the law they concern, at most 300 per law (the collector's own cap), the newest first.
    Interpretations always get their detail, court rulings only when at most 90 days old."""
    ruling = F.col("ord") % 2 == 0
    rows = K.kr(spark, d).select("ord", dates.norm_case_date(F.col("pub_date")).alias("decided_at"), C.target_law(F.col("title"), F.col("body")).alias("target_law"), (~ruling | dates.is_recent(F.col("pub_date"), F.lit("1998-08-02").cast("date"), 90)).alias("detail")).where("target_law <> ''")
    salted = Window.partitionBy("target_law", F.pmod(F.xxhash64("ord"), F.lit(32))).orderBy(F.desc("decided_at"), "ord")
    near = rows.withColumn("_r", F.row_number().over(salted)).where("_r <= 300")
    return near.withColumn("_r", F.row_number().over(Window.partitionBy("target_law").orderBy(F.desc("decided_at"), "ord"))).where("_r <= 300").drop("_r")


def statute_load(rows: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Load statute rows (``id, law_id, law_type, order_idx, body``) with delegations and order numbers into the table at
    ``path``, a partition for each law and type. Laws that are stored already are skipped unless ``force`` replaces them."""
    spark = rows.sparkSession
    filled = rows.where(T.nz(F.col("body")) != "")
    if not force:
        stored = spark.read.parquet(path).select("law_id").distinct()
        filled = filled.join(stored, "law_id", "left_anti")
    filled = filled.withColumn("refs", F.array_join(T.delegation_refs(F.col("body"), F.col("law_type")), ","))
    # one law's articles may be many: numbers come from ranges of the order column
    part = F.floor(F.col("order_idx") / 1000)
    counts = filled.groupBy("law_id", "law_type", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("law_id", "law_type").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy("law_id", "law_type", "part").orderBy("order_idx", "id")
    local = filled.withColumn("part", part).withColumn("at", F.row_number().over(own))
    made = local.join(base, ["law_id", "law_type", "part"]).select("id", (F.col("base") + F.col("at")).alias("place"), "refs", "law_id", "law_type")
    tables.replace_partition(made, path, ["law_id", "law_type"])
    return spark.read.schema("id string, place long, refs string, law_id string, law_type string").parquet(path)


STATUTES_SQL = " UNION ALL ".join(f"SELECT id, law_id, law_type, order_idx, body FROM ({x})" for x in (B.ACTS, B.DECREES, B.RULES))


@K.query(f"SELECT id, law_id, law_type, row_number() OVER (PARTITION BY law_id ORDER BY order_idx, id) AS place, CASE WHEN law_type = 'enforce' THEN 'stored' ELSE {K.DELEGATION_SQL} END AS refs FROM ({STATUTES_SQL})")
def q12_statute_load(spark: SparkSession, d: str) -> DataFrame:
    """The decrees are stored already and stay as they are; acts and rules are loaded, the acts a second time by force."""
    path = tables.shared_path(spark)
    columns = ["id", "law_id", "law_type", "order_idx", "body"]
    decrees = B.view(spark, d, B.DECREES).select(*columns)
    statute_load(decrees, path, force=True)
    rows = tables.checkpointed(spark.read.parquet(path).withColumn("refs", F.lit("stored")))
    tables.replace_partition(rows, path, ["law_id", "law_type"])
    acts = B.view(spark, d, B.ACTS).select(*columns)
    statute_load(acts.unionByName(decrees).unionByName(B.view(spark, d, B.RULES).select(*columns)), path)
    return statute_load(acts, path, force=True)


@K.query(f"""
WITH u AS (SELECT * FROM ({B.RULES}) WHERE NOT regexp_matches(body || ' ' || jo_title, {K.s(K.NAMED_RE2)}) AND NOT regexp_matches(body || ' ' || jo_title, {K.s(K.SHORT_RE2)})),
f AS (SELECT DISTINCT jo_no FROM (SELECT body, min(order_idx) AS order_idx FROM u GROUP BY body) JOIN u USING (body, order_idx))
SELECT r.id, '규정§9' || CASE WHEN f.jo_no IS NULL THEN '' ELSE ',법§' || CAST(r.jo_no % 50 + 1 AS STRING) END AS refs FROM ({B.RULES}) r LEFT JOIN f ON f.jo_no = r.jo_no""")
def q13_reference_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Unmapped rules in batches of five as prompts; the replies' JSON becomes act references of the rules. Replies are
    stored; here they are made up from the article numbers, as no model is called."""
    rules = tables.checkpointed(B.view(spark, d, B.RULES).withColumn("delegation_refs", F.array(F.lit("규정§9"))))
    rows = firstwins.first_wins(C.unmapped(rules), "body", "order_idx").groupBy("order_idx").agg(F.first("jo_no").alias("jo_no"), F.min("jo_label").alias("jo_label"), F.min("body").alias("body"))
    batches = firstwins.batch_number(rows, "order_idx")
    line = F.struct("order_idx", F.concat("jo_label", F.lit(": "), F.substring("body", 1, 400)).alias("x"), "jo_no")
    prompts = batches.groupBy("batch").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    reply = F.concat(F.lit("here it is:\n```json\n"), F.to_json(F.struct(F.transform("lines", lambda x: F.struct(x["jo_no"].alias("jo_no"), F.array((x["jo_no"] % 50 + 1).cast("int")).alias("acts"))).alias("rows"))), F.lit("\n```"))
    replies = prompts.select("batch", F.array_join(F.transform("lines", lambda x: x["x"]), "\n").alias("prompt"), reply.alias("reply"))
    found = replies.select(F.inline(T.json_from_text(F.col("reply"), "rows array<struct<jo_no: int, acts: array<int>>>")["rows"]))
    mapping = found.groupBy("jo_no").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("acts")))).alias("acts"))
    return X.apply_mapping(rules, mapping).select("id", F.array_join("delegation_refs", ",").alias("refs"))


WORDS_OF_LAYOUT = """
SELECT CAST(l_orderkey % 200 AS STRING) AS doc, CAST(l_orderkey % 50 AS INT) AS page, CASE WHEN l_linenumber = 1 THEN '제' || CAST(l_partkey % 90 + 1 AS STRING) || '조' ELSE l_returnflag END AS text,
CAST(l_orderkey % 997 * 10 AS DOUBLE) AS top, CAST(CASE WHEN l_linenumber % 2 = 1 THEN 10 ELSE 600 END + l_suppkey % 50 AS DOUBLE) AS x0, CAST(CASE WHEN l_linenumber % 2 = 1 THEN 40 ELSE 640 END + l_suppkey % 50 AS DOUBLE) AS x1 FROM {lineitem}
UNION ALL SELECT CAST(l_orderkey % 200 AS STRING), CAST(l_orderkey % 50 AS INT), '제' || CAST(l_suppkey % 90 + 1 AS STRING) || '조', CAST(l_orderkey % 997 * 10 AS DOUBLE), 590.0, 595.0 FROM {lineitem} WHERE l_linenumber = 1"""


HEAD_RE2 = r"^\s*제\s*(\d+)\s*(?:-\s*\d+\s*)?조"


@K.query(f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY top, x0, text) AS n FROM ({WORDS_OF_LAYOUT})),
g AS (SELECT doc, page, text, top, x0, x1, n, 0::BIGINT AS line, top AS anchor FROM w WHERE n = 1
UNION ALL SELECT w.doc, w.page, w.text, w.top, w.x0, w.x1, w.n, CASE WHEN abs(w.top - g.anchor) >= 5 THEN g.line + 1 ELSE g.line END, CASE WHEN abs(w.top - g.anchor) >= 5 THEN w.top ELSE g.anchor END FROM g JOIN w ON w.doc = g.doc AND w.page = g.page AND w.n = g.n + 1),
l AS (SELECT doc, page, line, coalesce(string_agg(text, ' ' ORDER BY x0, text) FILTER ((x0 + x1) / 2 < 290), '') AS act, coalesce(string_agg(text, ' ' ORDER BY x0, text) FILTER ((x0 + x1) / 2 >= 540), '') AS regulation FROM g GROUP BY 1, 2, 3),
v AS (SELECT doc, act, regulation, last_value(CASE WHEN regexp_matches(act, {K.s(HEAD_RE2)}) THEN CAST(regexp_extract(act, {K.s(HEAD_RE2)}, 1) AS INT) END IGNORE NULLS) OVER z AS a, last_value(CASE WHEN regexp_matches(regulation, {K.s(HEAD_RE2)}) THEN CAST(regexp_extract(regulation, {K.s(HEAD_RE2)}, 1) AS INT) END IGNORE NULLS) OVER z AS r FROM l WINDOW z AS (PARTITION BY doc ORDER BY page, line ROWS UNBOUNDED PRECEDING)),
m AS (SELECT r AS jo_no, string_agg(',법§' || CAST(a AS STRING), '' ORDER BY a) AS acts FROM (SELECT DISTINCT a, r FROM v WHERE a IS NOT NULL AND r IS NOT NULL AND (act <> '' OR regulation <> '')) GROUP BY r)
SELECT x.id, '규정§9' || coalesce(m.acts, '') AS refs FROM ({B.RULES}) x LEFT JOIN m USING (jo_no)""")
def q14_layout_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Article pairs of a page layout, written to the rules as act references."""
    pairs = layout.layout_pairs(B.view(spark, d, WORDS_OF_LAYOUT))
    mapping = X.collect_refs(pairs, "right", "left").withColumnRenamed("right", "jo_no")
    rules = B.view(spark, d, B.RULES).withColumn("delegation_refs", F.array(F.lit("규정§9")))
    return X.apply_mapping(rules, mapping).select("id", F.array_join("delegation_refs", ",").alias("refs"))


def format_selected(rows: DataFrame, day: str, places: list[int], order: str = "ord") -> DataFrame:
    """Per day the outlines of the articles at ``places`` (from 0, in ``order``), joined by a blank line."""
    at = rows.withColumn("_at", F.row_number().over(Window.partitionBy(day).orderBy(order)) - 1).where(F.col("_at").isin(*places))
    block = T.outline_block(F.col("agency"), F.col("title"), dates.display_date(F.col(day)), F.col("body"), F.lit(""))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("_at", block.alias("block")))), lambda x: x["block"])
    return at.groupBy(day).agg(F.array_join(blocks, "\n\n").alias("text"), F.count(F.lit(1)).alias("n"))


SHOWN_SQL = "'''' || substr(pub_date, 3, 2) || '.' || CAST(month(CAST(pub_date AS DATE)) AS STRING) || '.' || CAST(day(CAST(pub_date AS DATE)) AS STRING) || '(' || ['월', '화', '수', '목', '금', '토', '일'][isodow(CAST(pub_date AS DATE))] || ')'"
PICKED_SQL = f"(SELECT *, '' AS \"lead\" FROM (SELECT *, row_number() OVER (PARTITION BY pub_date ORDER BY ord) - 1 AS place FROM {K.KR}) WHERE place IN (0, 2, 3))"


@K.query(f"""
WITH {K._points_sql(PICKED_SQL, chr(34) + 'lead' + chr(34), 'o')},
x AS (SELECT *, list_slice(list_filter(CASE WHEN len(points) < 2 THEN list_concat(points, list_filter(list_filter(split, lambda y: length(y) > 10), lambda y: NOT list_contains(points, y))) ELSE points END, lambda y: length(y) > 8), 1, 4) AS shown FROM o)
SELECT pub_date, string_agg('◆ ' || coalesce(agency, '') || ' | 「' || {K._policy_name_sql()} || '」  ' || {SHOWN_SQL} || chr(10) || '  - ' || {K._summary_line_sql()} || chr(10) || chr(10) || '    • 주요 내용' || array_to_string(list_transform(shown, lambda y: chr(10) || '      - ' || y), ''), chr(10) || chr(10) ORDER BY place) AS text, count(*) AS n FROM x GROUP BY pub_date""")
def q16_format_selected(spark: SparkSession, d: str) -> DataFrame:
    """Of each day's list the first, third and fourth article."""
    return format_selected(K.kr(spark, d), "pub_date", [0, 2, 3])


@K.query("SELECT 'P' || CASE WHEN c_custkey < 1000 THEN lpad(CAST(c_custkey AS STRING), 3, '0') ELSE CAST(c_custkey AS STRING) END AS id, CASE WHEN c_custkey % 4 = 0 THEN 'updated' ELSE c_name END AS name FROM {customer} WHERE c_custkey % 10 <> 9 UNION ALL SELECT 'P' || CASE WHEN m + r < 1000 THEN lpad(CAST(m + r AS STRING), 3, '0') ELSE CAST(m + r AS STRING) END, s_name FROM (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS r FROM {supplier}), (SELECT max(c_custkey) AS m FROM {customer})")
def q17_policy_register(spark: SparkSession, d: str) -> DataFrame:
    """Create, update and delete over a register: customers are the register, suppliers new entries."""
    number = F.col("c_custkey").cast("string")
    key = F.concat(F.lit("P"), F.lpad(number, F.greatest(F.lit(3), F.char_length(number)), F.lit("0"))).alias("id")
    rows = K.t(spark, d, "customer").select(key, F.col("c_name").alias("name"), "c_custkey")
    new = tables.next_ids(rows, K.t(spark, d, "supplier").select("s_suppkey", F.lit(None).cast("string").alias("id"), F.col("s_name").alias("name")), "id", "s_suppkey")
    updated = tables.upsert(rows.select("id", "name"), rows.where("c_custkey % 4 = 0").select("id", F.lit("updated").alias("name")), "id")
    left = updated.join(rows.where("c_custkey % 10 = 9").select("id"), "id", "left_anti")
    return left.unionByName(new.select("id", "name"))


@K.query(f"SELECT page_id, length(main_text) AS n_chars, array_to_string({K._key_sentences_sql('main_text')}, '|') AS points, coalesce(n_links, 0) AS n_links FROM ({K.MAIN_SQL}) LEFT JOIN (SELECT page_id, count(*) AS n_links FROM ({K.LINKS_SQL}) GROUP BY 1) USING (page_id)")
def q_page_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Pages to monitor rows: main text, its key sentences, links."""
    pages = K.t(spark, d, "pages")
    main = html.extract_main_text(pages, [("article", "", "")])
    links = html.extract_links(pages, "^/", "https://site.example").groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"))
    return main.join(links, "page_id", "left").select("page_id", F.char_length("main_text").alias("n_chars"), F.array_join(T.key_sentences(F.col("main_text")), "|").alias("points"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


@K.query("SELECT ord, legal FROM (SELECT ord, CASE WHEN " + K.any_hit("title", D.CATEGORY_WORDS["AML"]) + f" THEN 'AML' END AS legal FROM {K.KR}) WHERE legal IS NOT NULL")
def q_aml_titles(spark: SparkSession, d: str) -> DataFrame:
    rows = K.kr(spark, d).where(T.contains_any(F.col("title"), D.CATEGORY_WORDS["AML"]))
    return rows.select("ord", F.lit("AML").alias("legal"))
