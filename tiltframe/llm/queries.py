"""One query per operator over its whole table, with production parameters, and SQL where it can say
the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltframe.llm import (
    chat, decontaminate, html, jaccard, katz, linededup, mtree, negatives, packing, periodic, sharding, toxicity, vectors,
)
from tiltframe.session import new_table_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: A conversation whose texts hold the template's own marks.
AWKWARD = """
SELECT -7L AS id, array(
  named_struct('role', 'user', 'content', r'\\### Assistant: </turn> ok'),
  named_struct('role', 'assistant', 'content', r'\\### Assistant: </turn> ok')) AS messages
""".replace("\\\\", "\\")


@query
def op1_chat_format(spark, sf):
    turns = chat.canonical_turns(table(spark, sf, "conversations"))
    turns = turns.unionByName(chat.canonical_turns(spark.sql(AWKWARD)))
    return chat.digests(chat.format_turns(turns))


ORACLES["op1_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), clean AS (
  SELECT conv_id, turn, role, coalesce(role, '') AS r, coalesce(text, '') AS t FROM turns
), marked AS (
  SELECT *,
    replace(replace(replace(t, '\', '\\'), '### ', '\h## '), '</turn>', '\l/turn>') AS body,
    replace(replace(replace(replace(r, '\', '\\'), '### ', '\h## '), '</turn>', '\l/turn>'), ':', '\c') AS head
  FROM clean
), whole AS (
  SELECT conv_id,
    count(*) AS n_turns,
    string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS LAST, r, t) AS turns,
    coalesce(string_agg(t, '' ORDER BY turn NULLS LAST, r, t) FILTER (WHERE role = 'assistant'), '') AS learned,
    sum(length('### ' || head || ': ' || body || '</turn>' || chr(10))) AS formatted
  FROM marked GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars,
  sha256(learned) AS loss_sha256, CAST(formatted AS BIGINT) AS formatted_chars
FROM whole
"""


@query
def op2_host_paths(spark, sf):
    return html.main_text(table(spark, sf, "pages"))


@query
def op3_cap_filters(spark, sf):
    return vectors.near_duplicates(table(spark, sf, "embeddings"))


def byte_bpe() -> str:
    """The public vocabulary file, which is installed alike on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op4_best_fit_packing(spark, sf):
    return packing.pack(packing.token_pieces(table(spark, sf, "documents"), byte_bpe()))


@query
def op5_jaccard_join(spark, sf):
    return jaccard.linked(table(spark, sf, "documents"), 3, 90)


@query
def op6_toxicity_chain(spark, sf):
    docs = table(spark, sf, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf, "labels")))


@query
def op7_string_tiling(spark, sf):
    return decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op8_virtual_slots(spark, sf):
    return sharding.shard_by_bytes(table(spark, sf, "documents"), 24)


@query
def op9_katz_backoff(spark, sf):
    return katz.score(table(spark, sf, "documents"))


@query
def op10_line_dedup(spark, sf):
    docs = table(spark, sf, "documents")
    return linededup.indexed(docs, new_table_path(spark, "line-index")).digests(docs)


ORACLES["op10_line_dedup"] = r"""
WITH parts AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents
), keyed AS (
  SELECT doc_id, n, line,
    translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM parts
), shared AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) > 1
), judged AS (
  SELECT k.*, first_doc IS NOT NULL AND k.doc_id <> first_doc AS lost
  FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query
def op11_residue_negatives(spark, sf):
    rows = table(spark, sf, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


ORACLES["op11_residue_negatives"] = r"""
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), plus AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM plus JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """A tenth of the documents, by the check sum of their ids, end in a period of their own words."""
    spaces = r"[ \t-\r]+"
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.withColumn("planted", F.coalesce(h % 10 == 0, F.lit(False))).withColumn("g", F.floor(h / 10))
    words = F.filter(F.split("text", spaces), lambda w: w != "")
    docs = docs.withColumn("words", F.when(F.col("planted"), words)).withColumn("n", F.size("words"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    docs = docs.withColumn("p", F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("int") + 1)
    cycle = F.slice("words", F.col("a") + 1, F.col("p"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(cycle, times)), F.lit(1), F.col("n") - F.col("a"))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return docs.withColumn("text", F.when(F.col("n") > 0, planted).otherwise(F.col("text"))).select("doc_id", "text")


@query
def op12_cover_runs(spark, sf):
    found = periodic.with_runs(with_planted_runs(table(spark, sf, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    longest = F.array_min(F.transform("runs", lambda r: F.struct(-r.length, r.start, r.period))).alias("longest")
    found = found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        longest,
        F.sha2(F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    length = -F.col("longest.col1")
    return found.select(
        "doc_id",
        "n_runs",
        F.col("longest.start").alias("start"),
        length.alias("length"),
        F.col("longest.period").alias("period"),
        F.floor(1000 * length / F.col("longest.period")).alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


ORACLES["op12_cover_runs"] = r"""
WITH RECURSIVE sums AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, 1 AS place, CAST(4294967295 AS BIGINT) AS c FROM documents
  UNION ALL
  SELECT doc_id, id, place + 1,
    list_reduce([xor(c, CAST(ascii(id[place]) AS BIGINT)), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)
  FROM sums WHERE place <= length(id)
), split AS (
  SELECT doc_id, xor(c, 4294967295) AS h,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM sums JOIN documents USING (doc_id) WHERE place > length(id)
), cut AS (
  SELECT *, len(words) AS n, CASE WHEN len(words) > 0 THEN (h // 10) % len(words) END AS a FROM split
), placed AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p, unnest(range(n)) AS i FROM cut
), words AS (
  SELECT doc_id, i, n, words[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS w FROM placed
), pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y
    ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), islands AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs
), stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island
  HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length
), told AS (
  SELECT doc_id, count(*) AS n_runs,
    arg_min(struct_pack(start := start, length := length, period := period), (-length, start, period)) AS longest,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
  FROM runs GROUP BY doc_id
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(longest.start AS BIGINT) AS start,
  CAST(longest.length AS BIGINT) AS length, CAST(longest.period AS BIGINT) AS period,
  CAST(1000 * longest.length // longest.period AS BIGINT) AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query
def op13_mtree_search(spark, sf):
    return mtree.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLES["op13_mtree_search"] = r"""
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank,
  vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
