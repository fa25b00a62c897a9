"""State, order and join operators: fixtures, properties against plain scans, streams against batches."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from regscope.operators import automaton, classify, cosine, crosswalk, digest, firstwins, layout, simjoin, tables
from regscope.operators import search as S
from regscope.sources import html, records
from regscope.streaming import jobs


def test_block_records(spark, tmp_path):
    (tmp_path / "a.txt").write_text("머리\n===== 보도자료 1 =====\n기관: 금융위\n제목: 첫째\n내용: 본문\n===== 보도자료 2 =====\n기관: 한은\n내용: 제목 없음\n", encoding="utf-8")
    fields = {"agency": "기관", "title": "제목", "body": "내용", "link": "링크"}
    got = records.read_block_records(spark, str(tmp_path), fields).orderBy("ord").collect()
    assert [(r.agency, r.title, r.body, r.link) for r in got] == [("금융위", "첫째", "본문", ""), ("한은", "", "제목 없음", "")]
    assert records.read_block_records(spark, str(tmp_path), fields, require="title").count() == 1


def test_json_records(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "a", "x": 1}, {"id": "b"}]))
    assert [(r.id, r.x) for r in records.read_json_records(spark, str(tmp_path / "a.json"), "id string, x int").orderBy("id").collect()] == [("a", 1), ("b", None)]


def test_flatten_statute_forms(spark):
    unit = {"조문번호": "3", "조문제목": "정의", "조문내용": "본문", "항": [{"항내용": "① 하나"}, "② 둘"]}
    one = {"법령": {"조문": {"조문단위": unit}}}
    many = {"법령": {"조문": {"조문단위": [{"조문번호": "제1조", "조문내용": ""}, unit]}}}
    rows = spark.createDataFrame([("a", json.dumps(one)), ("b", json.dumps(many)), ("c", "bad"), ("d", None)], "law_id string, doc string")
    got = [(r.law_id, r.jo_label, r.jo_title, r.body) for r in records.flatten_statute(rows).orderBy("law_id").collect()]
    assert got == [(k, "제3조", "정의", "본문\n① 하나\n② 둘") for k in "ab"]


def test_split_articles_forms(spark):
    lined = "머리말\n제1조(목적) 이 규정은 법 제3조에 따른다.\n제2조 정의\n제3-2조(특례)\n내용"
    blob = "머리 제1조(목적) 목적이다. 제2조에 따른다. 제2조(정의) 정의다."
    rows = spark.createDataFrame([(1, lined), (2, blob), (3, "제목만"), (4, None)], "k long, t string")
    got = [(r.k, r.number, r.title, r.body) for r in records.split_articles(rows, F.col("t"), "k").orderBy("k", "pos").collect()]
    assert got == [(1, "1", "목적", "이 규정은 법 제3조에 따른다."), (1, "2", "", "정의"), (1, "3-2", "특례", "내용"), (2, "1", "목적", "목적이다. 제2조에 따른다."), (2, "2", "정의", "정의다.")]


def test_html(spark):
    page = "<table><tr><th>번호</th><th>제목</th></tr><tr><td>1</td><td><a href='/no010101/7?x=1'>새 &amp; 소식 입니다N</a></td></tr><tr><td>x</td></tr></table><nav><p>menu</p></nav><article><p>본문 하나.</p><script>x()</script><p>둘.</p></article>"
    pages = spark.createDataFrame([(1, page), (2, None), (3, "<p>a<p>b")], "page_id long, html string")
    rows = html.html_table_rows(pages, min_cells=2).collect()
    assert [(r.cells, r.href) for r in rows] == [(["번호", "제목"], None), (["1", "새 & 소식 입니다N"], "/no010101/7?x=1")]
    assert [(r.text, r.url) for r in html.extract_links(pages, r"^/no\d+/\d+", "https://h").collect()] == [("새 &amp; 소식 입니다", "https://h/no010101/7")]
    main = {r.page_id: r.main_text for r in html.extract_main_text(pages, [("article", "", "")], min_len=3).collect()}
    assert main[1] == "본문 하나. 둘." and main[2] == "" and main[3] == "a b"


def test_replace_partition(spark, tmp_path):
    rows = spark.createDataFrame([("a", "act", 1), ("a", "rule", 2), ("b", "act", 3)], "law_id string, law_type string, v int")
    path = str(tmp_path / "t")
    tables.replace_partition(rows, path, ["law_id", "law_type"])
    tables.replace_partition(spark.createDataFrame([("a", "act", 9)], rows.schema), path, ["law_id", "law_type"])
    assert sorted(tuple(r[c] for c in ("law_id", "law_type", "v")) for r in spark.read.parquet(path).collect()) == [("a", "act", 9), ("a", "rule", 2), ("b", "act", 3)]


def test_updates_are_idempotent(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, None, "y")], "k int, a string, b string")
    new = spark.createDataFrame([(2, "n"), (3, "m")], "k int, a string")
    once = tables.upsert(target, new, "k")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(once) == [(1, "a", "x"), (2, "n", "y"), (3, "m", None)] == rows(tables.upsert(once, new, "k"))
    patch = spark.createDataFrame([(1, "", "p"), (2, "", ""), (None, "z", "z")], "k int, a string, b string")
    assert rows(tables.patch_nonempty(target, patch, "k").na.fill("-")) == [(1, "a", "p"), (2, "-", "y")]
    more = spark.createDataFrame([(2, "q", "q"), (4, "q", "q"), (4, "r", "r")], target.schema)
    assert rows(tables.insert_ignore(target.na.fill("-"), more, "k")) == [(1, "a", "x"), (2, "-", "y"), (4, "q", "q")]


def test_pick_source(spark):
    a, b = spark.range(2), spark.range(10, 15)
    pick = lambda x, y, m: sorted(r.id for r in tables.pick_source(x, y, m).collect())
    assert pick(a, b, "on_empty") == [0, 1] and pick(a.limit(0), b, "on_empty") == [10, 11, 12, 13, 14] == pick(a, b, "larger")


def test_first_wins_multi_drops_mark_nothing(spark):
    rows = spark.createDataFrame([(1, "l1", "t1"), (2, "l2", "t 1"), (3, "l2", "t3"), (4, "", ""), (5, None, None)], "ord long, link string, title string")
    assert sorted(r.ord for r in firstwins.first_wins_multi(rows).collect()) == [1, 3, 4, 5]


@pytest.mark.parametrize("seed", range(4))
def test_order_dependent_scans(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice(["", "a", "b", "c", "d", "e"]), r.choice(["", "t", "u", "v", "w"])) for i in range(40)]
    links, titles, want = set(), set(), []
    for i, link, title in rows:
        if (link and link in links) or (title and title in titles):
            continue
        links.add(link)
        titles.add(title)
        want.append(i)
    frame = spark.createDataFrame(rows, "ord long, link string, title string").repartition(3)
    assert sorted(x.ord for x in firstwins.first_wins_multi(frame).collect()) == want
    edges = [(i, j) for i in range(30) for j in range(i + 1, 30) if r.random() < 0.1]
    heads, lead = [], {}
    for i in range(30):
        near = [h for h in heads if (h, i) in set(edges)]
        lead[i] = near[0] if near else i
        if not near:
            heads.append(i)
    made = firstwins.leaders(spark.range(30).withColumnRenamed("id", "ord"), spark.createDataFrame(edges or [(0, 0)], "a long, b long"))
    assert {x.ord: x.leader for x in made.collect()} == lead


def test_class_pairs_equal_brute_force(spark):
    r = random.Random(1)
    sets = [sorted(r.sample("abcdefghijkl", r.randrange(1, 9))) for _ in range(60)]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "ord long, t array<string>")
    classes = simjoin.token_classes(frame, F.col("t"), "ord")
    name = {r.ord: r["class"] for r in classes.collect()}
    for percent, measure in ((55, "jaccard"), (80, "jaccard"), (25, "larger")):
        want = set()
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                same = len(set(a) & set(b))
                whole = len(set(a) | set(b)) if measure == "jaccard" else max(len(a), len(b))
                if same / whole >= percent / 100:
                    want.add((name[i], name[j]))
        assert {(p.a, p.b) for p in simjoin.class_pairs(classes, classes, percent, measure).collect()} == want


def alike(a, b):
    """Rows ``ord, title, body`` are similar by their words."""
    found = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    t = [set(r[1].split()) for r in (a, b)]
    w = [set(f"{r[1]} {r[2] or ''}".split()) for r in (a, b)]
    return found(*t) >= 0.6 or found(*w) >= 0.55


def greedy(rows):
    led, heads = {}, []
    for r in sorted(rows):
        near = [h[0] for h in heads if alike(h, r)]
        led[r[0]] = min(near, default=r[0])
        if not near:
            heads.append(r)
    return led


@pytest.mark.parametrize(("heads", "finish"), [(1, 0), (3, 0), (16, 5), (16, 2000)])
def test_leader_rounds_equal_a_walk_in_order(spark, monkeypatch, heads, finish):
    monkeypatch.setattr(simjoin, "HEADS", heads)
    monkeypatch.setattr(simjoin, "FINISH", finish)
    r = random.Random(heads * 7 + finish)
    pool = [f"w{k}" for k in range(14)]
    rows = [(i, " ".join(r.sample(pool, r.randrange(0, 6))), " ".join(r.sample(pool, r.randrange(0, 5)))) for i in range(70)] + [(100, "", None), (101, "", ""), (102, "w1 w2", None), (103, "w2 w1", "")]
    frame = spark.createDataFrame(rows, "ord long, title string, body string").repartition(3)
    got = {x.ord: x.leader for x in simjoin.leader_groups(frame, pattern=r"\S+", stop=()).collect()}
    assert got == greedy(rows)


def test_a_cluster_of_alike_rows_writes_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "FINISH", 0)
    made = []
    plain = simjoin.similar_heads

    def counted(*args):
        found = plain(*args)
        made.append(found.count())
        return found

    monkeypatch.setattr(simjoin, "similar_heads", counted)
    rows = [(i, f"one two three four five six seven eight nine v{i}", "") for i in range(300)]
    got = simjoin.leader_groups(spark.createDataFrame(rows, "ord long, title string, body string"), pattern=r"\S+", stop=()).collect()
    assert {x.leader for x in got} == {0}
    assert sum(made) <= simjoin.HEADS * len(rows) < len(rows) * (len(rows) - 1) / 2


def test_hot_tokens_are_dealt_and_filters_keep_candidates_few(spark, monkeypatch):
    r = random.Random(5)
    sets = [["hot", *(f"t{r.randrange(400)}" for _ in range(12))] for _ in range(200)]
    sets += [[*s[:-1], f"new{k}"] for k, s in enumerate(sets[:60])]
    frame = spark.createDataFrame([(i, sorted(set(s))) for i, s in enumerate(sets)], "ord long, t array<string>")
    classes = simjoin.token_classes(frame, F.col("t"), "ord").where("class IS NOT NULL")
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.55}
    name = {r.ord: r["class"] for r in classes.collect()}
    for hot in (4000, 3):
        monkeypatch.setattr(simjoin, "HOT", hot)
        assert {(x.a, x.b) for x in simjoin.class_pairs(classes, classes, 55).collect()} == {(name[i], name[j]) for i, j in want}
    posts = simjoin.postings(classes, simjoin.token_counts(classes), 55)
    found = simjoin.candidates(posts, posts, 55, "jaccard").count()
    assert len(want) <= found <= 1.2 * len(want)


def test_similar_rows_go(spark):
    schema = "ord long, title string, body string, link string, agency string"
    ref = spark.createDataFrame([(100, "가상자산 거래소 규제 강화 방안", "본문", "l1", "")], schema)
    cur = spark.createDataFrame([(1, "가상자산 거래소 규제 강화 대책", "다른 본문", "l2", ""), (2, "전혀 다른 제목", None, "l1", ""), (3, "개인정보 유출 사고", "본문", None, "")], schema)
    assert [r.ord for r in simjoin.drop_similar(cur, ref).collect()] == [3]
    groups = {r.ord: r.leader for r in simjoin.leader_groups(cur.unionByName(ref)).collect()}
    assert groups == {1: 1, 2: 2, 3: 3, 100: 1}


def test_crosswalk_ways(spark):
    schema = "id string, jo_no int, jo_title string, body string, delegation_refs array<string>"
    enforce = spark.createDataFrame([("e1", 7, "가", "같은 법 제3조", []), ("e2", 9, "나", "인용 없음", None)], schema)
    rules = spark.createDataFrame([("r1", 1, "", "영 제7조에 따라", []), ("r2", 2, "", "관계법 제5조", []), ("r3", 3, "", "없음", ["법§4", "→하위"]), ("r4", 4, "", "「어떤 다른 법」 제8조", [])], schema)
    got = {(r.id, r.act_no) for r in crosswalk.crosswalk(enforce, rules).collect()}
    assert got == {("e1", 3), ("e2", 9), ("r1", 3), ("r2", None), ("r3", 4), ("r4", 8)}  # any named law counts


def test_lines_start_from_their_first_word(spark):
    words = spark.createDataFrame([("d", 1, "a", 0.0, 0.0, 9.0), ("d", 1, "b", 4.0, 0.0, 9.0), ("d", 1, "c", 8.0, 0.0, 9.0)], "doc string, page int, text string, top double, x0 double, x1 double")
    assert {r.text: r.line for r in layout.cluster_lines(words).collect()} == {"a": 0, "b": 0, "c": 1}


def test_law_lookup_tiers(spark):
    rows = spark.createDataFrame([("개인정보 보호법",), ("신용정보법",)], "law_name string")
    look = lambda n: [r.law_name for r in crosswalk.law_lookup(rows, n).collect()]
    assert look("개인정보보호법") == ["개인정보 보호법"] and look("신용 정보법") == ["신용정보법"] and look("없는 법") == []


def test_search_without_question_tokens(spark):
    items = spark.createDataFrame([(i, "가나 다라") for i in range(5)], "id long, text string")
    assert [r.id for r in S.search(items, "?", 3, "id", F.col("text")).collect()] == [0, 1, 2]


def test_relevance_looks_at_the_title_only(spark):
    rows = spark.createDataFrame([("오늘 날씨",), ("코인 뉴스브리핑",), ("코인 규제",)], "t string")
    assert [r[0] for r in rows.select(classify.is_relevant(F.col("t"))).collect()] == [False, False, True]


def test_streams_equal_batches(spark, tmp_path):
    from regscope import bindings

    rows = bindings.view(spark, "/root/testdata/sf0.001", bindings.STREAM_ROWS)
    path = str(tmp_path / "s")
    rows.repartition(5).write.parquet(path)
    log = str(tmp_path / "log")
    jobs.available_now(jobs.file_stream(spark, path, 2), writer=jobs.batch_writer(log, lambda b: b.select("url"), "url"))
    found = [r.url for r in spark.read.parquet(log).select("url").collect()]
    assert sorted(found) == sorted(r.url for r in rows.select("url").distinct().collect())
    out = jobs.available_now(jobs.unseen(jobs.file_stream(spark, path, 2)).select("url"))
    assert {r.url for r in spark.read.schema("url string").parquet(out).collect()} == set(found)
    dated, undated = jobs.split_undated(rows.withColumn("ts", F.when(F.col("event_id") % 2 == 0, F.col("ts"))))
    assert dated.count() + undated.count() == rows.count() and undated.count() > 0


def test_digest_text_keeps_every_article(spark):
    rows = [(k, "2024-01-01" if k % 9 else "2024-01-02", k % 3 == 0, f"title{k}", "b", "a", "") for k in range(600)]
    made = digest.digest_text(spark.createDataFrame(rows, "ord long, pub_date string, overseas boolean, title string, body string, agency string, link string"))
    found = {}
    for r in sorted(made.collect(), key=lambda r: (r.pub_date, r.chunk)):
        assert r.text.count("🔴") <= 200
        found.setdefault(r.pub_date, []).append(r.text)
    for day, texts in found.items():
        own = sorted((r for r in rows if r[1] == day), key=lambda r: (r[2], r[0]))
        home = sum(not r[2] for r in own)
        card = lambda no, r: f"🔴 [상]  #{no}  ({day})\n{r[3]}\n· 기관: a\n· 요약: b"
        cards = [card(no, r) for no, r in enumerate(own, 1)]
        sides = [("국내 동향", cards[:home]), ("해외 동향", cards[home:])]
        assert "".join(texts) == "\n\n".join(f"{name} ({len(c)}건)\n" + "\n".join(c) for name, c in sides if c)
    assert len(found["2024-01-01"]) == 3 and len(found["2024-01-02"]) == 1


@pytest.mark.parametrize(("shard_tokens", "posted"), [(4_000_000, 128), (25, 2)])
def test_top_matches_equals_a_plain_scan(spark, monkeypatch, shard_tokens, posted):
    r = random.Random(4)
    monkeypatch.setattr(S, "SHARD_TOKENS", shard_tokens)
    monkeypatch.setattr(S, "POSTED", posted)
    pool = [f"w{k}" for k in range(30)]
    items = [(f"i{k:03d}", [r.choice(pool) for _ in range(r.randrange(6))]) for k in range(90)] + [("i900", None)]
    asked = [(k, [r.choice(pool) for _ in range(r.randrange(1, 5))]) for k in range(9)] + [(99, [])]
    got = S.top_matches(
        spark.createDataFrame(items, "key string, t array<string>").repartition(3), spark.createDataFrame(asked, "req long, t array<string>"),
        "key", "req", F.array_distinct(F.coalesce("t", F.array().cast("array<string>"))), F.array_distinct("t"), 5,
    )
    want = []
    for q, words in asked:
        near = [(-len(set(words) & set(t or ())) / len(set(words) | set(t or ())), k) for k, t in items if set(words) & set(t or ())]
        want += [(q, k, -s, n + 1) for n, (s, k) in enumerate(sorted(near)[:5])]
    assert sorted((x.req, x.key, x.score, x["rank"]) for x in got.collect()) == sorted(want)


def test_search_stops_early_with_exact_results(spark):
    """Words of very different frequency, where rare words decide and common ones needn't be read."""
    r = random.Random(9)
    draw = lambda n: sorted({int(r.paretovariate(0.6)) % 4000 for _ in range(n)})
    items = [(k, [str(w) for w in draw(r.randrange(1, 40))]) for k in range(600)]
    asked = [(k, r.sample(items[k * 7][1], max(1, len(items[k * 7][1]) * 2 // 3)) + ["1", "2", "3"]) for k in range(40)]
    index = S.build_index(spark.createDataFrame(items, "key long, t array<string>"), "key", F.col("t"), 1)
    got = S.search_index(index, spark.createDataFrame(asked, "req long, t array<string>"), "req", F.array_distinct("t"), 5).collect()
    want = []
    for q, words in asked:
        near = [(-len(set(words) & set(t)) / len(set(words) | set(t)), k) for k, t in items if set(words) & set(t)]
        want += [(q, k, -s, n + 1) for n, (s, k) in enumerate(sorted(near)[:5])]
    assert sorted((x.req, x.key, x.score, x["rank"]) for x in got) == sorted(want)


def test_cosine_links_equal_a_plain_scan(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(3)
    monkeypatch.setattr(cosine, "BLOCK_ROWS", 9)
    base = r.normal(size=(6, 8))
    rows = [(k, [float(x) for x in base[k % 6] + 0.4 * r.normal(size=8)]) for k in range(60)] + [(100, None), (101, []), (102, [0.0] * 8), (103, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in rows if v and any(v)}
    for cut in (0.88, 0.3):
        want = {(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cut}
        got = [(x.a, x.b) for x in cosine.cosine_links(frame, frame, cut).collect()]
        assert len(got) == len(set(got)) and {(min(p), max(p)) for p in got} == want
        odd, even = frame.where("vec_id % 2 = 1"), frame.where("vec_id % 2 = 0")
        left = {x.vec_id for x in cosine.embedding_exclude(even, odd, cut).collect()}
        assert left == {k for k, _ in rows if k % 2 == 0 and not any((min(k, b), max(k, b)) in want for b in unit if b % 2)}
    assert cosine.cosine_links(frame.limit(0), frame, 0.5).count() == 0


def test_cells_that_cannot_meet_are_not_compared(spark, monkeypatch):
    """On clustered vectors few pairs are compared, in small blocks too, and the links are those of a plain scan."""
    r = np.random.default_rng(4)
    heads = r.normal(size=(25, 16))
    v = [(heads[k % 25] + 0.12 * r.normal(size=16)).tolist() for k in range(600)] + [heads[3].tolist()] * 40
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    unit = np.array(v) / np.linalg.norm(v, axis=1)[:, None]
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.88, 1)), strict=True)}
    monkeypatch.setattr(cosine, "CELL_ROWS", 16)
    assert cosine.compared_share(frame, 0.88) < 0.2
    for block in (4000, 30):
        monkeypatch.setattr(cosine, "BLOCK_ROWS", block)
        got = [(x.a, x.b) for x in cosine.cosine_links(frame, frame, 0.88).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        half = {x.vec_id for x in cosine.embedding_exclude(frame.where("vec_id % 5 = 0"), frame.where("vec_id % 5 <> 0"), 0.88).collect()}
        assert half == {a for a in range(0, 640, 5) if not any(unit[a] @ unit[b] >= 0.88 for b in range(640) if b % 5)}
    led, heads_of = {}, []
    for k in range(640):
        near = [h for h in heads_of if (h, k) in want]
        led[k] = near[0] if near else k
        if not near:
            heads_of.append(k)
    assert {x.vec_id: x.leader for x in cosine.vector_groups(frame, 0.88).collect()} == led


def test_vector_leaders_make_no_list_of_pairs(spark, monkeypatch):
    """Any number of rounds gives the groups of a plain scan, and vectors of other lengths or none are apart."""
    r = np.random.default_rng(8)
    v = [r.normal(size=12).tolist() for _ in range(300)]
    rows = [(f"k{k:04}", x) for k, x in enumerate([*v, *v[:20], *(x[:5] for x in v[:60]), [0.0] * 12, [], None])]
    frame = spark.createDataFrame(rows, "vec_id string, embedding array<double>").repartition(3)
    unit = {k: np.array(x) / max(np.linalg.norm(x), 1e-300) for k, x in rows if x}
    led, heads = {k: k for k, _ in rows}, []
    first = {}
    for k, x in rows:
        if k in unit:
            one = first.setdefault(tuple(x), k)
            near = [h for h in heads if len(unit[h]) == len(unit[k]) and unit[h] @ unit[k] >= 0.3]
            led[k] = led[one] if one != k else near[0] if near else k
            if led[k] == k:
                heads.append(k)
    monkeypatch.setattr(cosine, "class_links", None)
    for most in (8 << 20, 40 * 96, 1):
        rows_in = frame if most > 1 else frame.where("vec_id < 'k0004'")
        monkeypatch.setattr(cosine, "WALKED_BYTES", most)
        got = {x.vec_id: x.leader for x in cosine.vector_groups(rows_in, 0.3).collect()}
        assert got == {k: h for k, h in led.items() if most > 1 or k < "k0004"}
    assert cosine.vector_groups(frame.limit(0), 0.3).count() == 0


def test_dictionary_grades_agree_at_any_size(spark, monkeypatch):
    from regscope.functions import dicts

    rows = spark.createDataFrame([(1, "특금법 개정", "본문"), (2, "간담회 참석", None), (3, None, ""), (4, "과태료 위반 제재", "x")], "ord long, title string, body string")
    few = {r.ord: r.grade for r in classify.grade_by_dictionary(rows, dicts.dictionary_rows(spark)).collect()}
    monkeypatch.setattr(automaton, "CHARS", 200)  # many automata
    many = {r.ord: r.grade for r in classify.grade_by_dictionary(rows, dicts.dictionary_rows(spark)).collect()}
    plain = {r.ord: r.grade for r in rows.select("ord", classify.priority_grade(F.col("title"), F.col("body")).alias("grade")).collect()}
    assert few == many == plain and set(few.values()) == {"상", "중", "하"}


def test_lines_of_long_pages_equal_a_walk(spark):
    r = random.Random(3)
    rows = [(d, p, f"t{k}", round(r.uniform(0, 400), 1), float(k)) for d in ("a", None) for p in (1, 2) for k in range(120)]
    frame = spark.createDataFrame([(*x, x[4] + 1) for x in rows], "doc string, page int, text string, top double, x0 double, x1 double").repartition(3)
    want, anchors = {}, {}
    for d, p, text, top, x0 in sorted(rows, key=lambda x: (str(x[0]), x[1], x[3], x[4])):
        line, anchor = anchors.get((d, p), (-1, None))
        if anchor is None or top >= anchor + 5:
            line, anchor = line + 1, top
        anchors[d, p] = (line, anchor)
        want[d, p, text] = line
    assert {(x.doc, x.page, x.text): x.line for x in layout.cluster_lines(frame).collect()} == want


def test_carried_values_cross_tasks(spark):
    r = random.Random(6)
    rows = [(d, k, r.choice((None, None, None, k)), r.choice((None, None, -k)), r.random() < 0.7) for d in ("long", "x", None) for k in range(400 if d == "long" else 5)]
    frame = spark.createDataFrame(rows, "doc string, n int, a int, b int, f boolean").repartition(5)
    want, seen = set(), {}
    for d, _, a, b, f in rows:
        x, y = seen.get(d, (None, None))
        seen[d] = x, y = (x if a is None else a, y if b is None else b)
        if f and x is not None and y is not None:
            want.add((d, x, y))
    got = [tuple(x) for x in layout.carry_forward_pairs(frame, "doc", ["n"], F.col("a"), F.col("b"), F.col("f")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("files", [1, 4])
def test_first_rows_by_timers_do_not_depend_on_batches(spark, files):
    import datetime

    r = random.Random(2)
    start = datetime.datetime(2024, 1, 1)
    rows = sorted((start + datetime.timedelta(hours=r.randrange(24 * 20)), k, f"u{r.randrange(6)}") for k in range(120))
    path = tables.shared_path(spark)
    for k in range(4):
        part = spark.createDataFrame([(u, i, t) for t, i, u in rows[k * 30 : k * 30 + 30]], "url string, event_id long, ts timestamp")
        part.coalesce(1).write.mode("append").parquet(path)
    out = jobs.available_now(jobs.first_in_order(jobs.file_stream(spark, path, files)).select("url", "event_id"))
    got = {(x.url, x.event_id) for x in spark.read.schema("url string, event_id long").parquet(out).collect()}
    mark, last, want = rows[-1][0] - datetime.timedelta(days=3), {}, set()
    for t, i, u in rows:
        if t < mark and (u not in last or t > last[u] + datetime.timedelta(days=3)):
            last[u] = t
            want.add((u, i))
    assert got == want


def test_automaton_finds_all_words_of_large_dictionaries(spark):
    r = random.Random(8)
    words = list(dict.fromkeys("".join(r.choice("ab가나") for _ in range(r.randrange(1, 9))) for _ in range(30_000)))
    texts = [(k, "".join(r.choice("ab가나 ") for _ in range(60))) for k in range(30)] + [(100, None), (101, "")]
    frame = spark.createDataFrame(texts, "k long, hits string")
    got = {x.k: {words[i] for i in x.found} for x in automaton.with_hits(frame, F.col("hits"), words, "found").collect()}
    assert got == {k: {w for w in words if t and w in t} for k, t in texts}
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    pairs = {(x.k, x.term) for x in automaton.hit_terms(frame, F.col("hits"), terms, "k").collect()}
    assert pairs == {(k, w) for k, found in got.items() for w in found}
    hits = automaton.with_hits(frame, F.col("hits"), ["a", "b"], "n").select("k", automaton.count_hits(F.col("n"), ["a", "b"], ["a", "a", "b"]).alias("n")).collect()
    assert {x.k: x.n for x in hits} == {k: 2 * ("a" in (t or "")) + ("b" in (t or "")) for k, t in texts}
    assert all(x.n == [] for x in automaton.with_hits(frame, F.col("hits"), [], "n").collect())


def test_decoding_of_legacy_bytes(spark):
    from regscope.functions import ids
    from regscope.functions import text as T

    raw = ["한글".encode(), "한글".encode("cp949"), b"\xef\xbb\xbfmark", b"bad\xff", None]
    got = [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(raw)], "k int, b binary").orderBy("k").select(ids.decode_text(F.col("b"))).collect()]
    assert got == ["한글", "한글", "mark", "bad�", None]
    found = spark.createDataFrame([(" &lt;b&gt;&nbsp;a  &eacute;&#x41; ",), (None,)], "t string").select(T.clean_entities(F.col("t")).alias("a"), T.clean_entities(F.col("t"), True).alias("b")).collect()
    assert [tuple(r) for r in found] == [("<b>\xa0a  éA", "a éA"), ("", "")]


def test_digest_sections_and_empty_days(spark):
    article = "ord long, pub_date string, overseas boolean, title string, body string, agency string, link string"
    rows = spark.createDataFrame([(1, "d1", False, "one", None, None, "l1")], article)
    bills = spark.createDataFrame([(2, "d1", "bill", "", "공포", "l2"), (3, "d2", "other", "부처", "시행", "")], "ord long, pub_date string, bill_title string, ministry string, status string, link string")
    titles = spark.createDataFrame([(4, "d1", "t4", "l4"), (5, "d1", "t5", None)], "ord long, pub_date string, title string, link string")
    days = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "pub_date string")
    got = {r.pub_date: (r.n, r.text) for r in digest.digest_text(rows, bills=bills, titles=titles, days=days).collect()}
    assert got["d1"] == (4, "국내 동향 (1건)\n🔴 [상]  #1  (d1)\none\n· 기관: -\n· 원문: l1\n\n입법동향 (1건)\n⚖️ [입법]  #2\nbill\n· 부처: -\n· 단계: 공포\n· 원문: l2\n\n전체 기사 (2건)\n1. t4\n    l4\n2. t5")
    assert got["d2"] == (1, "입법동향 (1건)\n⚖️ [입법]  #1\nother\n· 부처: 부처\n· 단계: 시행") and got["d3"][0] == 0


def test_log_of_batches_that_drop_all_their_rows_is_empty(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "url string")
    path, log = tables.shared_path(spark), tables.shared_path(spark)
    rows.write.parquet(path)
    jobs.available_now(jobs.file_stream(spark, path, 2), writer=jobs.batch_writer(log, lambda b: b.where("url > 'b'"), "url"))
    assert jobs.logged(spark, log, "url string").collect() == []
    assert jobs.logged(spark, tables.shared_path(spark), "url string").collect() == []
    jobs.available_now(jobs.file_stream(spark, path, 2), writer=jobs.batch_writer(log, lambda b: b, "url"))
    assert sorted(jobs.logged(spark, log, "url string").collect()) == [("a",), ("b",)]


def test_references_without_semicolon_stay_as_written(spark):
    from regscope.functions import text as T

    text = "a&amp b&amp;amp c&copy;&copyx; &#65;&#66 &; &"
    rows = spark.createDataFrame([(1, f"<article>{text}</article><table><tr><td>{text}</td><td><a href='?a=1&lt=2&amp;b'>x</a></td></tr></table>")], "page_id long, html string")
    want = "a&amp b&amp c©&copyx; A&#66 &; &"
    assert html.extract_main_text(rows, [("article", "", "")], min_len=3).first().main_text == want
    assert tuple(html.html_table_rows(rows).select("cells", "href").first()) == ([want, "x"], "?a=1&lt=2&b")
    plain = F.lit(text)
    assert tuple(spark.range(1).select(T.clean_entities(plain, bare=False), T.clean_entities(plain)).first()) == (want, "a& b& c©©x; AB &; &".replace("b&", "b&amp", 1))


def test_index_packs_tokens_into_pieces(spark):
    items = [(k, [f"w{k}-{j}" for j in range(10)] + ["all"]) for k in range(200)]
    index = S.build_index(spark.createDataFrame(items, "key long, t array<string>"), "key", F.col("t"), 1)
    assert index.count() == 1  # not a row for each of 2,001 tokens
    got = S.search_index(index, spark.createDataFrame([(1, ["all", "w7-3", "none"])], "req long, t array<string>"), "req", F.col("t"), 2).collect()
    assert [(x.key, x.score, x["rank"]) for x in sorted(got, key=lambda x: x["rank"])] == [(7, 2 / 12, 1), (0, 1 / 13, 2)]


def test_table_rows_leave_the_worker_in_bounded_frames(spark, monkeypatch):
    monkeypatch.setattr(html, "ROWS", 3)
    page = "<table>" + "<tr><td>a</td></tr>" * 4 + "</table>"
    pages = spark.createDataFrame([(k, page) for k in range(5)], "page_id long, html string")
    got = html.html_table_rows(pages).select("page_id", "row_no").collect()
    assert sorted(map(tuple, got)) == [(k, n) for k in range(5) for n in range(1, 5)]


def test_crosswalk_reads_rule_texts_once_and_keeps_repeated_rows(spark, tmp_path):
    schema = "id string, jo_no int, jo_title string, body string, delegation_refs array<string>"
    enforce = spark.createDataFrame([("e1", 7, "", "같은 법 제3조, 법 제4조", []), ("e2", 8, "", "없음", [])], schema)
    rules = [("r1", 1, "", "영 제7조, 영 제8조와 법 제3조", []), ("r2", 2, "", "영 제8조와 영 제9조", []), ("r2", 2, "", "없음", []), ("r3", 3, "", "없음", []), ("r3", 3, "", "법 제5조", [])]
    spark.createDataFrame(rules, schema).write.parquet(str(tmp_path / "rules"))
    found = crosswalk.crosswalk(enforce, spark.read.parquet(str(tmp_path / "rules")))
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    got = sorted((r.side[0], r.id, r.act_no or 0) for r in found.collect())
    assert got == [("e", "e1", 3), ("e", "e1", 4), ("e", "e2", 8), ("r", "r1", 3), ("r", "r1", 4), ("r", "r2", 0), ("r", "r2", 0), ("r", "r3", 5)]


def test_lines_are_walked_without_rounds_of_tables(spark, monkeypatch):
    monkeypatch.setattr(layout, "checkpointed", None)
    rows = [(d, p, float(3 * k)) for d in ("a", None) for p in (1, 2) for k in range(40)] + [("a", 1, None)]
    frame = spark.createDataFrame([(d, p, "", t, 0.0, 1.0) for d, p, t in rows], "doc string, page int, text string, top double, x0 double, x1 double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted((str(r.doc), r.page, -1 if r.top is None else r.top, r.line) for r in layout.cluster_lines(frame).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted((str(d), p, -1 if t is None else t, None if t is None else int(t // 6)) for d, p, t in rows)


def test_addresses_share_groups_of_state(spark):
    import datetime

    start = datetime.datetime(2024, 1, 1)
    path = tables.shared_path(spark)
    spark.createDataFrame([(f"u{k}", k, start + datetime.timedelta(seconds=k)) for k in range(2000)] + [("u5", 9000, start + datetime.timedelta(days=9))], "url string, event_id long, ts timestamp").coalesce(1).write.parquet(path)
    out, state = tables.shared_path(spark), tables.shared_path(spark)
    job = jobs.first_in_order(jobs.file_stream(spark, path)).writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").option("path", out).start()
    job.awaitTermination()
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in job.recentProgress) <= 512
    assert spark.read.schema("url string, event_id long").parquet(out).select("event_id").distinct().count() == 2000


def test_postings_of_a_join_hold_numbers_for_classes(spark, monkeypatch):
    held = []
    plain = simjoin.candidates
    monkeypatch.setattr(simjoin, "candidates", lambda a, b, *rest: held.append(dict(a.dtypes)) or plain(a, b, *rest))
    frame = spark.createDataFrame([(1, ["x", "y", "z"]), (2, ["x", "y", "z", "q"]), (3, ["k"]), (4, ["x", "y", "z"])], "ord long, t array<string>")
    classes = simjoin.token_classes(frame, F.col("t"), "ord")
    name = {r.ord: r["class"] for r in classes.collect()}
    got = {(r.a, r.b, r.score) for r in simjoin.class_pairs(classes.where("ord <> 2"), classes.where("ord <> 1"), 60).collect()}
    assert "string" not in held[0].values()
    assert got == {(name[1], name[2], 0.75), (name[1], name[4], 1.0), (name[3], name[3], 1.0)}


def test_leaders_leave_the_postings_of_later_rounds(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "HEADS", 2)
    monkeypatch.setattr(simjoin, "FINISH", 0)
    met = []
    plain = simjoin.similar_heads
    monkeypatch.setattr(simjoin, "similar_heads", lambda posts, *rest: met.append(posts.select("node").distinct().count()) or plain(posts, *rest))
    rows = [(i, f"own{i} alone{i}", "") for i in range(20)] + [(100 + i, f"one two three four v{i}", "") for i in range(9)]
    got = simjoin.leader_groups(spark.createDataFrame(rows, "ord long, title string, body string"), pattern=r"\S+", stop=()).collect()
    assert {r.leader for r in got if r.ord >= 100} == {100} and met[0] == 29 and max(met[1:]) <= 9


@pytest.mark.parametrize(("heads", "scan"), [(1, 2_000_000_000), (2, 40), (16, 40), (16, 2_000_000_000)])
def test_leader_rounds_write_no_postings(spark, monkeypatch, heads, scan):
    """Tokens that reach over batches, take heads in part or stop at the bound of comparisons; only pairs and rows are written."""
    monkeypatch.setattr(simjoin, "HEADS", heads)
    monkeypatch.setattr(simjoin, "SCAN", scan, raising=False)
    monkeypatch.setattr(simjoin, "FINISH", 3)
    made = []
    plain = simjoin.checkpointed
    monkeypatch.setattr(simjoin, "checkpointed", lambda frame: made.append(frame.columns) or plain(frame))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    r = random.Random(heads)
    pool = [f"w{k}" for k in range(30)]
    rows = [(i, " ".join(r.sample(pool, r.randrange(1, 5))), "") for i in range(60)] + [(60 + i, f"one two three v{i % 3}", f"u{i}") for i in range(30)]
    try:
        frame = spark.createDataFrame(rows, "ord long, title string, body string")
        got = {x.ord: x.leader for x in simjoin.leader_groups(frame, pattern=r"\S+", stop=()).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == greedy(rows)
    assert made and not any("token" in columns or "w0" in columns for columns in made)


def test_leader_groups_of_rows_named_by_strings(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "HEADS", 2)
    monkeypatch.setattr(simjoin, "FINISH", 0)
    rows = [(f"k{i:03}", f"one two three four v{i}", "") for i in range(40)] + [(f"z{i}", f"own{i} alone{i}", None) for i in range(5)]
    got = simjoin.leader_groups(spark.createDataFrame(rows, "ord string, title string, body string"), pattern=r"\S+", stop=()).collect()
    assert {x.ord: x.leader for x in got} == greedy(rows)


def test_a_cluster_compares_its_tokens_with_its_leader_only(spark, monkeypatch):
    compared = []
    plain = simjoin.similar_heads
    monkeypatch.setattr(simjoin, "FINISH", 0)
    monkeypatch.setattr(simjoin, "similar_heads", lambda rows, met, *rest: compared.append(met.select("node", "head").distinct().count()) or plain(rows, met, *rest))
    rows = [(i, f"one two three four five six seven eight nine v{i}", "") for i in range(60)]
    got = simjoin.leader_groups(spark.createDataFrame(rows, "ord long, title string, body string"), pattern=r"\S+", stop=()).collect()
    assert {x.leader for x in got} == {0} and sum(compared) == 59


def test_rows_of_keys_are_told_without_a_shuffle(spark, monkeypatch):
    rows = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("node"), F.array("id").alias("t0"))
    keys = spark.range(0, 2000, 7).select(F.concat(F.lit("k"), "id").alias("x"))
    want = {f"k{i}" for i in range(0, 2000, 7)}
    found = simjoin.only(rows, keys)
    assert found.schema.simpleString() == rows.schema.simpleString() and {r.node for r in found.collect()} == want
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(simjoin, "SLOTS", 64)  # a bitmap that is too small lets others pass, and loses none
    assert {r.node for r in simjoin.only(rows, keys).collect()} >= want
    assert simjoin.only(rows, keys.limit(0)).count() == 0


def test_copies_that_stay_nodes_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "SLOTS", 1)  # every copy stays
    monkeypatch.setattr(simjoin, "FINISH", 2)
    r = random.Random(4)
    pool = [f"w{k}" for k in range(12)]
    rows = [(i, " ".join(r.sample(pool, r.randrange(0, 4))), "") for i in range(60)]
    rows += [(60 + i, rows[i % 20][1], "") for i in range(40)]
    got = {x.ord: x.leader for x in simjoin.leader_groups(spark.createDataFrame(rows, "ord long, title string, body string"), pattern=r"\S+", stop=()).collect()}
    assert got == greedy(rows)
