"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regscope.llm import centroids, chat_format, decontaminate, exact_dedup, line_dedup, mixing, near_dedup, resampling, secrets, sharding, style_trees, token_output, toxicity
from regscope.llm.common import stored
from regscope.operators.tables import shared_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"), keep="largest")


OP1 = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)
"""


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_classes(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", "kept", "partner_id", "similarity")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark)
    token_output.write_tokens(read(spark, sf_dir, "documents"), path, vocabulary, END_ID)
    return token_output.read_tokens(spark, path, with_ids=False).drop("ids")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a conversation. Its digests are of whole conversations, so a conversation's text becomes one value here; the
    operator itself works on chunks of turns."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    chunks = stored(chat_format.render(chat_format.fold_events(chat_format.turn_events(rows.unionByName(extra)))))
    turns = chat_format.read_back(chunks)
    per_chunk = turns.select(
        "conv_id",
        "chunk",
        F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("all"),
        F.array_join("trained", "").alias("trained"),
        F.col("chars").cast("long").alias("chars"),
    )
    whole = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", c))), lambda p: p[c]), "")
    return (
        per_chunk.groupBy("conv_id")
        .agg(F.sum("n").alias("n_turns"), whole("all").alias("all"), whole("trained").alias("trained"), F.sum("chars").alias("formatted_chars"))
        .select(
            "conv_id",
            "n_turns",
            F.sha2("all", 256).alias("turns_sha256"),
            F.char_length("trained").cast("long").alias("loss_chars"),
            F.sha2("trained", 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )


def _escaped(column: str) -> str:
    for sign, code in chat_format.ESCAPES:
        column = f"replace({column}, '{sign}', '{code}')"
    return column


OP5 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_escaped("role")}) + length({_escaped("text")}) + {len(chat_format.OPEN + chat_format.MIDDLE + chat_format.CLOSE)})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents"))


def held_out(name: str = "doc_id") -> Column:
    return F.crc32(F.col(name).cast("string")) % 3 == 1


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), ~held_out())
    return toxicity.score_rows(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.pack(read(spark, sf_dir, "documents"), 8)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(docs))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    many = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "model")
    return found.select("doc_id", many("assign"), many("access"), many("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP10 = r"""
WITH l AS (
  SELECT doc_id, line, n, lower_key AS key FROM (
    SELECT doc_id, line, n, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
    FROM (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)))),
k AS (SELECT key, min(doc_id) AS first_doc FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id <> k.first_doc AS gone FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def _features(table: str, key: str) -> str:
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""SELECT k, w FROM (SELECT k, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS w
    FROM (SELECT {key} AS k, regexp_extract_all({lowered}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM {table}))"""


OP11 = rf"""
WITH RECURSIVE
f AS MATERIALIZED ({_features("documents", "doc_id")}),
g AS MATERIALIZED ({_features("benchmark", "item_id")}),
v AS MATERIALIZED (SELECT w, hex(encode(w)) AS code FROM (SELECT w FROM f UNION SELECT w FROM g)),
step AS MATERIALIZED (SELECT i AS byte, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS value FROM (SELECT unnest(range(256)) AS i)),
crc AS (
  SELECT w, code, 0 AS pos, 4294967295::BIGINT AS state FROM v
  UNION ALL
  SELECT w, code, pos + 1, xor(step.value, state >> 8) FROM crc JOIN step ON step.byte = xor(state, ('0x' || substr(code, 2 * pos + 1, 2))::BIGINT) & 255 WHERE 2 * pos < length(code)),
b AS MATERIALIZED (SELECT w, xor(state, 4294967295) % 10000 AS bucket FROM crc WHERE 2 * pos = length(code)),
have AS (SELECT bucket, count(*) AS s FROM f JOIN b USING (w) GROUP BY bucket),
want AS (SELECT bucket, count(*) AS t FROM g JOIN b USING (w) GROUP BY bucket),
gain AS MATERIALIZED (
  SELECT i AS bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT count(*) FROM f)::DOUBLE + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT count(*) FROM g)::DOUBLE + 10000))))::BIGINT AS gain
  FROM (SELECT unnest(range(10000)) AS i) LEFT JOIN have ON have.bucket = i LEFT JOIN want ON want.bucket = i),
sums AS (SELECT k, count(*) AS n, sum(gain)::BIGINT AS total, count(*) FILTER (instr(w, ' ') = 0) AS words FROM f JOIN b USING (w) JOIN gain USING (bucket) GROUP BY k),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(words, 0) AS words, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS lot
  FROM documents LEFT JOIN sums ON k = doc_id),
ranked AS (SELECT doc_id, n_features, weight, weight + lot AS score, words, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY weight + lot DESC, doc_id) END AS place FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
  CASE WHEN place <= 25 * (SELECT count(*) FROM ranked WHERE words >= 20) // 100 THEN place END AS rank
FROM ranked
"""


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(read(spark, sf_dir, "embeddings"))


def _rounds() -> str:
    """The rounds of clustering, a step each: pairs of vectors and centroids, the nearest, the new centroids."""
    parts = []
    for n in range(centroids.ROUNDS + 1):
        parts.append(
            f"""d{n} AS MATERIALIZED (SELECT u, c, list_sum(list_transform(list_zip(v, p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM x CROSS JOIN c{n}),
a{n} AS MATERIALIZED (SELECT u, (min({{'d': distance, 'c': c}})).d AS distance, (min({{'d': distance, 'c': c}})).c AS c FROM d{n} GROUP BY u)"""
        )
        if n < centroids.ROUNDS:
            parts.append(
                f"""m{n} AS (SELECT c, i, (s - ((s % n) + n) % n) // n AS q FROM (SELECT c, i, sum(e)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS e, unnest(range(1, 65)) AS i FROM a{n} JOIN x USING (u)) GROUP BY c, i)),
c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(l.p, c{n}.p) AS p FROM c{n} LEFT JOIN (SELECT c, list(q ORDER BY i) AS p FROM m{n} GROUP BY c) l USING (c))"""
            )
    return ",\n".join(parts)


OP12 = f"""
WITH kept AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
x AS MATERIALIZED (SELECT row_number() OVER () AS u, vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS v FROM kept),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS p FROM (SELECT sha256('2:' || vec_id) AS h, v FROM x ORDER BY h, v LIMIT 40)),
{_rounds()}
SELECT vec_id, c::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c{centroids.ROUNDS}.p, ',')) AS centroid_sha256
FROM a{centroids.ROUNDS} JOIN x USING (u) JOIN c{centroids.ROUNDS} USING (c)
"""


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_trees.main_texts(read(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1, "op5_chat_format": OP5, "op10_line_dedup": OP10, "op11_importance_resampling": OP11, "op12_centroid_clustering": OP12}
