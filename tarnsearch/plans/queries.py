"""Registered queries of the search engine over whole tables, and their SQL counterparts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsearch import qa
from tarnsearch.api import as_json
from tarnsearch.functions import text as tx
from tarnsearch.functions import vectors as vf
from tarnsearch.functions import web
from tarnsearch.operators import index as ix
from tarnsearch.operators import manifest as mf
from tarnsearch.operators import rank, vectors
from tarnsearch.sources import crawl, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file_name"), "text")


def _index(spark: SparkSession, sf_dir: str) -> ix.Index:
    return ix.build(_docs(spark, sf_dir))


def _joined(c: str) -> F.Column:
    return F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",").alias(c)


# Pieces of SQL.


def _sql_list(values: tuple[str, ...] | list) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v) for v in values)


_SPACE, _SEPARATOR = tx.SPACE, tx.SEPARATOR
_STOP = _sql_list(tx.STOP_WORDS)


def _sql_tokens(text: str) -> str:
    return f"""list_filter(list_transform(string_split_regex(coalesce({text}, ''), '{_SEPARATOR}'),
      lambda x: regexp_replace(regexp_replace(lower(x), 'gonna$', 'going to'), 'wanna$', 'want to')),
      lambda x: length(x) BETWEEN 2 AND 50 AND x NOT IN ({_STOP}))"""


_NORMAL = f"trim(regexp_replace(text, '{_SPACE}+', ' ', 'g'))"
_TOK = f"tok AS (SELECT doc_id, t[i] AS tok, i - 1 AS pos FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, {_sql_tokens('text')} AS t FROM documents)))"
_POST = f"{_TOK}, post AS (SELECT doc_id, tok, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM tok GROUP BY doc_id, tok)"
_LEN = f"{_POST}, dl AS (SELECT d.doc_id, count(p.tok) AS length FROM documents d LEFT JOIN post p ON d.doc_id = p.doc_id GROUP BY d.doc_id)"
_STATS = f"{_LEN}, cs AS (SELECT count(*) AS n_docs, avg(length) AS avg_length FROM dl)"
_CHUNKS = rf"""cut AS (SELECT doc_id, regexp_extract_all({_NORMAL}, '(?s).{{120,255}}[.!?]|.{{1,256}}') AS c FROM documents),
starts AS (SELECT doc_id, c, coalesce(sum(len(c)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM cut),
chunk AS (SELECT start + i - 1 AS chunk_id, doc_id, i - 1 AS chunk_no, c[i] AS text, len(c) AS n FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM starts))"""
_VECTOR = f"list_transform(range(64), lambda i: len(list_filter(list_transform({_sql_tokens('text')}, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 64), lambda b: b = i))::DOUBLE)"


def _sql_norm(v: str) -> str:
    return f"sqrt(list_sum(list_transform({v}, lambda x: x::DOUBLE * x::DOUBLE)))"


def _sql_hits(text: str) -> str:
    words = tx.tokens_of(text)
    times = Counter(words)
    m = "CASE " + " ".join(f"WHEN tok = '{t}' THEN {n}" for t, n in times.items()) + " END"
    lists = ", ".join(f"any_value(positions) FILTER (WHERE tok = '{t}')" for t in words)
    return f"""{_STATS}, hit AS (SELECT *, {m} AS m FROM post WHERE tok IN ({_sql_list(list(times))})),
fr AS (SELECT tok, count(*) AS df FROM hit GROUP BY tok),
wt AS (SELECT h.*, m * ln((n_docs - df * m + 0.5) / (df * m + 0.5) + 1) * (h.tf * 2.5 / (1.5 * (0.25 + 0.75 * length / avg_length) + h.tf)) AS s
  FROM hit h JOIN fr ON h.tok = fr.tok JOIN dl ON h.doc_id = dl.doc_id CROSS JOIN cs),
agg AS (SELECT doc_id, sum(s) AS bm25, count(*) = {len(times)} AS all_terms_present, list_filter([{lists}], lambda x: x IS NOT NULL) AS lists FROM wt GROUP BY doc_id),
prx AS (SELECT *, CASE WHEN len(lists) < 2 THEN 0.0 ELSE 1.0 / (1 + coalesce(list_min(list_filter(list_transform(lists[1],
  lambda a: CASE WHEN len(list_filter(lists, lambda l: l[-1] < a)) = 0 THEN list_max(list_transform(lists, lambda l: list_min(list_filter(l, lambda p: p >= a)))) - a END),
  lambda z: z IS NOT NULL)), 1000000)) END::DOUBLE AS proximity FROM agg),
kw AS (SELECT doc_id, round(bm25, 9) AS bm25_score, proximity, round(bm25 * (1 + proximity), 9) AS score, all_terms_present FROM prx)"""


# Tokens, postings, statistics.


@query(f"WITH {_TOK} SELECT doc_id, tok, pos::BIGINT AS pos FROM tok")
def tokenize_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(tx.tokens(F.col("text"))).alias("pos", "tok")).select("doc_id", "tok", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {_POST} SELECT doc_id, tok, tf::BIGINT AS tf, array_to_string(positions, ',') AS positions FROM post")
def postings_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.postings(_docs(spark, sf_dir)).select("doc_id", "tok", "tf", _joined("positions"))


@query(f"WITH {_TOK} SELECT tok, count(*)::BIGINT AS total_tf FROM tok GROUP BY tok")
def global_term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).term_stats.select("tok", "total_tf")


@query(f"WITH {_POST} SELECT tok, count(*)::BIGINT AS df FROM post GROUP BY tok")
def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).term_stats.select("tok", "df")


@query(f"WITH {_LEN} SELECT doc_id, length::BIGINT AS length FROM dl")
def doc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.doc_stats(_docs(spark, sf_dir))


@query(f"WITH {_STATS} SELECT n_docs::BIGINT AS n_docs, round(avg_length, 6) AS avg_length FROM cs")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).corpus_stats.select("n_docs", F.round("avg_length", 6).alias("avg_length"))


@query(f"SELECT doc_id, list_filter({_sql_tokens('text')}, lambda x: NOT regexp_matches(x, '^[0-9.-]*[0-9][0-9.-]*$')).len()::BIGINT AS n_words, {_sql_tokens('text')}.len()::BIGINT AS n_tokens FROM documents")
def number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(tx.tokens(text, tx.TokenOptions(remove_numbers=True))).cast("long").alias("n_words"), F.size(tx.tokens(text)).cast("long").alias("n_tokens"))


@query(f"SELECT doc_id, md5({_NORMAL}) AS normal FROM documents")
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.normal_text(F.col("text"))).alias("normal"))


# Chunks.


@query(f"WITH {_CHUNKS} SELECT chunk_id, doc_id, chunk_no, text FROM chunk")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.chunk_table(_docs(spark, sf_dir))


@query(f"WITH {_CHUNKS} SELECT doc_id, len(c)::BIGINT AS chunk_count FROM cut")
def chunk_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.size(tx.chunks(F.col("text"))).cast("long").alias("chunk_count"))


@query(f"SELECT doc_id, md5({_NORMAL}) AS text FROM documents WHERE {_NORMAL} <> ''")
def reassemble_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.whole_texts(ix.chunk_table(_docs(spark, sf_dir))).select("doc_id", F.md5("text").alias("text"))


@query(f"WITH {_CHUNKS} SELECT chunk_id, doc_id, text FROM chunk WHERE doc_id = 42 AND chunk_no = 0")
def chunk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.chunk_table(_docs(spark, sf_dir)).where("doc_id = 42 and chunk_no = 0").select("chunk_id", "doc_id", "text")


@query(f"""WITH {_CHUNKS} SELECT a.chunk_id, a.doc_id, md5(string_agg(b.text, ' ' ORDER BY b.chunk_no)) AS context FROM chunk a JOIN chunk b
ON a.doc_id = b.doc_id AND b.chunk_no >= greatest(0, least(a.chunk_no - 1, a.n - 3)) AND b.chunk_no < greatest(0, least(a.chunk_no - 1, a.n - 3)) + 3 GROUP BY a.chunk_id, a.doc_id""")
def close_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.contexts(ix.chunk_table(_docs(spark, sf_dir))).select("chunk_id", "doc_id", F.md5("context").alias("context"))


# Keyword search.

_WORDS, _TWICE = "that que des", "as this as"


@query(f"WITH {_sql_hits(_WORDS)} SELECT doc_id, tok, tf::BIGINT AS tf, round(s, 6) AS weight FROM wt")
def bm25_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.term_weights(_index(spark, sf_dir), tx.tokens_of(_WORDS)).select("doc_id", "tok", "tf", F.round("weight", 6).alias("weight"))


@query(f"WITH {_sql_hits(_WORDS)} SELECT doc_id, round(bm25_score, 6) AS bm25_score, all_terms_present FROM kw")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.keyword_hits(_index(spark, sf_dir), tx.tokens_of(_WORDS)).select("doc_id", F.round("bm25_score", 6).alias("bm25_score"), "all_terms_present")


@query(f"WITH {_sql_hits(_WORDS)} SELECT doc_id, round(proximity, 9) AS proximity FROM kw")
def proximity_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.keyword_hits(_index(spark, sf_dir), tx.tokens_of(_WORDS)).select("doc_id", F.round("proximity", 9).alias("proximity"))


_TOP = "SELECT doc_id, round(bm25_score, 6) AS bm25_score, round(proximity, 6) AS proximity, round(score, 6) AS score, all_terms_present FROM kw ORDER BY kw.score DESC, doc_id LIMIT 20"


def _top(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    rows = rank.keyword_top(_index(spark, sf_dir), text, 20)
    return rows.select("doc_id", *(F.round(c, 6).alias(c) for c in ("bm25_score", "proximity", "score")), "all_terms_present")


@query(f"WITH {_sql_hits(_WORDS)} {_TOP}")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, _WORDS)


@query(f"WITH {_sql_hits(_TWICE)} {_TOP}")
def keyword_search_dup_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, _TWICE)


@query(f"WITH {_sql_hits(_WORDS)}, cut AS (SELECT * FROM kw ORDER BY score DESC, doc_id LIMIT 5) SELECT doc_id, source AS file_name, round(bm25_score, 6) AS bm25_score, row_number() OVER (ORDER BY bm25_score DESC, doc_id)::BIGINT AS place FROM cut JOIN documents USING (doc_id)")
def keyword_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rank.numbered(rank.keyword(_index(spark, sf_dir), _WORDS, 5))
    return rows.select("doc_id", "file_name", F.round("bm25_score", 6).alias("bm25_score"), F.col("number").alias("place"))


@query(f"WITH {_sql_hits(_WORDS)}, best AS (SELECT doc_id FROM kw ORDER BY score DESC, doc_id LIMIT 20) SELECT doc_id, tok, tf::BIGINT AS tf, array_to_string(positions, ',') AS positions FROM hit JOIN best USING (doc_id)")
def matched_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rank.keyword_top(_index(spark, sf_dir), _WORDS, 20).select("doc_id", F.explode("positions").alias("tok", "p"))
    return rows.select("doc_id", "tok", F.col("p.term_frequency").cast("long").alias("tf"), F.array_join(F.col("p.positions").cast("array<string>"), ",").alias("positions"))


# Vectors.


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("long").alias("doc_id"), "embedding")


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    row = _embeddings(spark, sf_dir).where("chunk_id = 0").first()
    return list(map(float, row["embedding"])) if row else []


_UNIT = f"e AS (SELECT vec_id AS chunk_id, label::BIGINT AS doc_id, CASE WHEN {_sql_norm('embedding')} > 0 THEN list_transform(embedding, lambda x: x::DOUBLE / {_sql_norm('embedding')}) ELSE list_transform(embedding, lambda x: x::DOUBLE) END AS v FROM embeddings)"
_SIM = f"{_UNIT}, q AS (SELECT v AS q FROM e WHERE chunk_id = 0), s AS (SELECT chunk_id, doc_id, round(list_sum(list_transform(list_zip(v, q), lambda z: z[1] * z[2])), 9) AS similarity FROM e CROSS JOIN q)"


@query(f"SELECT vec_id AS chunk_id, round({_sql_norm('embedding')}, 6) AS norm FROM embeddings")
def vector_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.norms(_embeddings(spark, sf_dir)).select("chunk_id", F.round("norm", 6).alias("norm"))


@query(f"WITH {_SIM} SELECT chunk_id, doc_id, round(similarity, 6) AS similarity FROM s ORDER BY s.similarity DESC, chunk_id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.prepared(_embeddings(spark, sf_dir), 64)
    return vectors.search(rows, _first_vector(spark, sf_dir), 10).select("chunk_id", "doc_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_UNIT}, q AS (SELECT chunk_id AS query_id, v AS q FROM e WHERE chunk_id % 20 = 0), s AS (SELECT query_id, chunk_id, doc_id, round(list_sum(list_transform(list_zip(v, q), lambda z: z[1] * z[2])), 9) AS similarity FROM e CROSS JOIN q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS place FROM s) SELECT query_id, chunk_id, doc_id, round(similarity, 6) AS similarity FROM r WHERE place <= 10")
def vector_topk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are all rows whose id is divisible by 20."""
    rows = vectors.prepared(_embeddings(spark, sf_dir), 64)
    asked = rows.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    return vectors.search_table(rows, asked, 10).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_SIM}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, chunk_id) AS place FROM s WHERE similarity >= 0) SELECT doc_id, round(avg(similarity), 6) AS near, count(*)::BIGINT AS n FROM r WHERE place <= 3 GROUP BY doc_id")
def vector_topk_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = vectors.prepared(_embeddings(spark, sf_dir), 64)
    q = vectors.unit_list(_first_vector(spark, sf_dir))
    rows = rows.select("chunk_id", "doc_id", F.round(vf.dot(F.col("embedding"), vf.literal(q)), 9).alias("similarity")).where("similarity >= 0")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("similarity"), "chunk_id"))
    return rows.withColumn("place", place).where("place <= 3").groupBy("doc_id").agg(F.round(F.avg("similarity"), 6).alias("near"), F.count("*").alias("n"))


@query("SELECT count(*)::BIGINT AS n, sum(vec_id)::BIGINT AS ids FROM embeddings WHERE vec_id % 3 <> 0")
def vector_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir)
    return vectors.without(rows, rows.where("chunk_id % 3 = 0")).agg(F.count("*").alias("n"), F.sum("chunk_id").alias("ids"))


@query(f"WITH {_UNIT} SELECT chunk_id, array_to_string(list_transform(v, lambda x: round(x, 4)::DECIMAL(10, 4)::VARCHAR), ',') AS v FROM e WHERE chunk_id = 7")
def vector_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.vector_of(vectors.prepared(_embeddings(spark, sf_dir), 64), 7)
    return rows.select("chunk_id", F.array_join(F.transform("embedding", lambda x: F.round(x, 4).cast("decimal(10,4)").cast("string")), ",").alias("v"))


@query(f"WITH {_CHUNKS}, h AS (SELECT chunk_id, doc_id, {_VECTOR} AS v FROM chunk) SELECT chunk_id, doc_id, round({_sql_norm('v')}, 6) AS raw_norm, list_sum(v)::BIGINT AS n_tokens, list_position(v, list_max(v))::BIGINT AS top FROM h")
def hash_embed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ix.chunk_table(_docs(spark, sf_dir)).select("chunk_id", "doc_id", vf.hashed(F.col("text")).alias("v"), F.size(tx.tokens(F.col("text"))).cast("long").alias("n_tokens"))
    # Scaled counts sum to tokens / norm, which gives the norm back.
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    raw = F.when(total > 0, F.col("n_tokens") / total).otherwise(0.0)
    return rows.select("chunk_id", "doc_id", F.round(raw, 6).alias("raw_norm"), "n_tokens", F.array_position("v", F.array_max("v")).cast("long").alias("top"))


def _hashed(index: ix.Index) -> DataFrame:
    rows = index.chunks.select("chunk_id", "doc_id", vf.hashed(F.col("text")).alias("embedding"))
    return vectors.prepared(rows, vf.HASH_DIMENSION)


_ASK = "re onha"
_ASK_VECTOR = "[" + ", ".join(map(repr, vf.hashed_of(_ASK))) + "]"
_CHUNK_SIM = f"""hv AS (SELECT chunk_id, doc_id, text, {_VECTOR} AS v FROM chunk),
hs AS (SELECT chunk_id, doc_id, text, round(CASE WHEN {_sql_norm('v')} > 0 THEN list_sum(list_transform(list_zip(v, {_ASK_VECTOR}), lambda z: z[1] * z[2])) / {_sql_norm('v')} ELSE 0 END, 9) AS similarity FROM hv)"""


@query(f"WITH {_CHUNKS}, {_CHUNK_SIM} SELECT hs.doc_id, source AS file_name, round(similarity, 6) AS combined_score, chunk_id, hs.text AS chunk_text FROM hs JOIN documents d ON hs.doc_id = d.doc_id ORDER BY hs.similarity DESC, chunk_id LIMIT 10")
def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    rows = rank.semantic(index, _hashed(index), vf.hashed_of(_ASK), 10)
    return rows.select("doc_id", "file_name", F.round("combined_score", 6).alias("combined_score"), F.col("chunk_id")[0].alias("chunk_id"), F.col("chunk_text")[0].alias("chunk_text"))


def _sql_fused(k: int, keyword_weight: float, semantic_weight: float) -> str:
    n = 10 * k
    return f"""WITH {_sql_hits(_ASK)}, {_CHUNKS}, {_CHUNK_SIM},
l AS (SELECT * FROM kw ORDER BY score DESC, doc_id LIMIT {n}),
r0 AS (SELECT * FROM hs ORDER BY similarity DESC, chunk_id LIMIT {n}),
r1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, chunk_id) AS place FROM r0 WHERE similarity >= 0),
r AS (SELECT doc_id, avg(similarity) AS near, list(chunk_id ORDER BY place) AS c FROM r1 WHERE place <= 3 GROUP BY doc_id),
f AS (SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, coalesce(bm25_score, 0) AS bm25_score, coalesce(near, 0) AS semantic_score, l.doc_id IS NOT NULL AS found,
  round(coalesce(bm25_score, 0) / coalesce(nullif((SELECT max(bm25_score) FROM l), 0), 1) * {keyword_weight} + coalesce(near, 0) * {semantic_weight}, 9) AS combined_score,
  coalesce(all_terms_present, false) AS all_terms_present, coalesce(c, []) AS c FROM l FULL JOIN r ON l.doc_id = r.doc_id WHERE (SELECT count(*) FROM l) > 0),
t AS (SELECT * FROM f ORDER BY combined_score DESC, doc_id LIMIT {k})"""


def _fused(spark: SparkSession, sf_dir: str, k: int, *weights: float) -> DataFrame:
    index = _index(spark, sf_dir)
    return rank.fused(index, _hashed(index), _ASK, vf.hashed_of(_ASK), k, *weights)


_SCORES = "SELECT doc_id, round(bm25_score, 6) AS bm25_score, round(semantic_score, 6) AS semantic_score, round(combined_score, 6) AS combined_score, all_terms_present FROM t"


def _scores(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", *(F.round(c, 6).alias(c) for c in ("bm25_score", "semantic_score", "combined_score")), "all_terms_present")


@query(f"{_sql_fused(10, 0.5, 0.5)} {_SCORES}")
def hybrid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(_fused(spark, sf_dir, 10))


@query(f"{_sql_fused(10, 1.0, 0.0)} {_SCORES}")
def hybrid_weights_keyword_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(_fused(spark, sf_dir, 10, 1.0, 0.0))


_KEPT = """k AS (SELECT *, CASE WHEN len(c) = 0 THEN [] WHEN len(c) = 1 THEN [c[1]]
  WHEN len(c) = 2 THEN CASE WHEN abs(c[2] - c[1]) > 1 THEN [c[1], c[2]] ELSE [c[1]] END
  WHEN abs(c[2] - c[1]) > 1 THEN CASE WHEN abs(c[3] - c[1]) > 1 AND abs(c[3] - c[2]) > 1 THEN [c[1], c[2], c[3]] ELSE [c[1], c[2]] END
  WHEN abs(c[3] - c[1]) > 1 THEN [c[1], c[3]] ELSE [c[1]] END AS kept FROM t),
x AS (SELECT doc_id, i, kept[i] AS chunk_id FROM (SELECT doc_id, kept, unnest(range(1, len(kept) + 1)) AS i FROM k)),
y AS (SELECT x.doc_id, x.i, trim(string_agg(b.text, ' ' ORDER BY b.chunk_no)) AS context FROM x JOIN chunk a ON a.chunk_id = x.chunk_id JOIN chunk b ON b.doc_id = a.doc_id
  AND b.chunk_no >= greatest(0, least(a.chunk_no - 1, a.n - 3)) AND b.chunk_no < greatest(0, least(a.chunk_no - 1, a.n - 3)) + 3 GROUP BY x.doc_id, x.i),
z AS (SELECT doc_id, list(context ORDER BY i) AS texts FROM y WHERE context <> '' GROUP BY doc_id),
res AS (SELECT k.doc_id, CASE WHEN found THEN d.source ELSE 'Unknown' END AS file_name, combined_score, kept, coalesce(texts, ['No relevant chunk identified']) AS texts FROM k LEFT JOIN documents d ON k.doc_id = d.doc_id LEFT JOIN z ON k.doc_id = z.doc_id)"""


def _hybrid(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    index = _index(spark, sf_dir)
    return rank.hybrid(index, _hashed(index), _ASK, vf.hashed_of(_ASK), k)


@query(f"{_sql_fused(10, 0.5, 0.5)}, {_KEPT} SELECT doc_id, file_name, round(combined_score, 6) AS combined_score, array_to_string(kept, ',') AS chunk_id, array_to_string(texts, '|') AS chunk_text FROM res")
def hybrid_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hybrid(spark, sf_dir, 10)
    return rows.select("doc_id", "file_name", F.round("combined_score", 6).alias("combined_score"), _joined("chunk_id"), F.array_join("chunk_text", "|").alias("chunk_text"))


@query(f"{_sql_fused(3, 0.5, 0.5)}, {_KEPT}, one AS (SELECT doc_id, combined_score, array_to_string(texts, chr(10) || chr(10)) AS part FROM res) SELECT string_agg(part, chr(10) || chr(10) ORDER BY combined_score DESC, doc_id) AS context FROM one")
def qa_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.context(_hybrid(spark, sf_dir, 3))


@query("SELECT conv_id, turn, 'Context: ' || coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') || chr(10) || chr(10) || 'Question: ' || text AS prompt FROM conversations")
def qa_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _table(spark, sf_dir, "conversations")
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    return rows.select("conv_id", "turn", qa.prompt(before, F.col("text")).alias("prompt"))


@query()
def search_result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_json(_hybrid(spark, sf_dir, 5))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS snippet FROM documents")
def result_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


# Pages and URLs.

_STRIPPED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?is)<!doctype[^>]*>', '', 'g')"""

_PARTED = _STRIPPED.replace("'', 'g'", "'<i>', 'g'")


def _sql_decoded(x: str) -> str:
    for name, c in web.ENTITIES:
        x = f"replace({x}, '{name}', '{c.replace(chr(39), chr(39) * 2)}')"
    return x


_NORMAL_URL = rf"""regexp_extract({{u}}, '{web.PARTS}', 1).lower() || '://' || regexp_extract({{u}}, '{web.PARTS}', 2).lower() ||
  CASE WHEN regexp_replace(regexp_extract({{u}}, '{web.PARTS}', 3), ';[^/]*$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract({{u}}, '{web.PARTS}', 3), ';[^/]*$', '') END ||
  CASE WHEN regexp_extract({{u}}, '{web.PARTS}', 4) <> '' THEN '?' || array_to_string(list_sort(string_split(regexp_extract({{u}}, '{web.PARTS}', 4), '&')), '&') ELSE '' END"""
_LINKS = rf"""a AS (SELECT url, i - 1 AS place, replace(regexp_replace(h[i], '^["'']', ''), '&amp;', '&') AS href FROM (SELECT url, h, unnest(range(1, len(h) + 1)) AS i FROM
  (SELECT url, regexp_extract_all(html, '{web.LINK.replace(chr(39), chr(39) * 2)}', 1) AS h FROM pages))),
b AS (SELECT url, place, href, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href
  WHEN starts_with(href, '//') THEN regexp_extract(url, '{web.PARTS}', 1) || ':' || href
  WHEN starts_with(href, '/') THEN regexp_extract(url, '{web.PARTS}', 1) || '://' || regexp_extract(url, '{web.PARTS}', 2) || href
  WHEN href = '' THEN url WHEN starts_with(href, '#') THEN regexp_replace(url, '#.*$', '') || href
  WHEN starts_with(href, '?') THEN regexp_extract(url, '{web.PARTS}', 1) || '://' || regexp_extract(url, '{web.PARTS}', 2) || regexp_extract(url, '{web.PARTS}', 3) || href
  ELSE regexp_extract(url, '{web.PARTS}', 1) || '://' || regexp_extract(url, '{web.PARTS}', 2) || regexp_replace(CASE WHEN regexp_extract(url, '{web.PARTS}', 3) = '' THEN '/' ELSE regexp_extract(url, '{web.PARTS}', 3) END, '[^/]*$', '') || href END AS target FROM a)"""


@query(f"SELECT page_id, md5({_sql_decoded(f'''regexp_replace({_STRIPPED}, '(?s)</?[a-zA-Z][^>]*>', '', 'g')''')}) AS text FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(web.html_text(F.col("html"))).alias("text"))


@query(f"SELECT page_id, array_to_string(list_filter(list_transform(string_split_regex({_PARTED}, '(?s)</?[a-zA-Z][^>]*>'), lambda x: regexp_replace({_sql_decoded('x')}, '^[\\p{{Z}}\\s\\x{{0b}}]+|[\\p{{Z}}\\s\\x{{0b}}]+$', '', 'g')), lambda x: x <> ''), ' ') AS text FROM pages")
def crawl_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", web.html_text(F.col("html"), " ").alias("text"))


@query(f"WITH {_LINKS} SELECT url, place, href, target FROM b")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = crawl.ranked_links(_table(spark, sf_dir, "pages"))
    return rows.select("url", F.col("place").cast("long").alias("place"), "href", web.absolute(F.col("href"), F.col("url")).alias("target"))


@query(f"WITH {_LINKS} SELECT DISTINCT target, {_NORMAL_URL.format(u='target')} AS normal FROM b WHERE regexp_matches(target, '{web.PARTS}')")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = crawl.ranked_links(_table(spark, sf_dir, "pages")).select(web.absolute(F.col("href"), F.col("url")).alias("target")).distinct()
    return rows.where(F.col("target").rlike(web.PARTS)).select("target", web.normal_url(F.col("target")).alias("normal"))


_SCOPE = ("site1.example.com", "site2.example.com")


@query(f"SELECT url, regexp_extract(url, '{web.PARTS}', 2) IN ({_sql_list(_SCOPE)}) AND starts_with(regexp_extract(url, '{web.PARTS}', 3), '/') AS in_scope FROM pages")
def url_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("url", web.in_scope(F.col("url"), list(_SCOPE), "/").alias("in_scope"))


@query(f"WITH {_LINKS} SELECT DISTINCT target, len(list_filter([{_sql_list(web.BANNED)}], lambda x: contains(lower(target), x))) > 0 AS banned FROM b")
def url_banned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = crawl.ranked_links(_table(spark, sf_dir, "pages")).select(web.absolute(F.col("href"), F.col("url")).alias("target")).distinct()
    return rows.select("target", web.banned(F.col("target")).alias("banned"))


@query(f"""WITH {_LINKS}, e AS (SELECT {_NORMAL_URL.format(u='url')} AS src, {_NORMAL_URL.format(u='target')} AS dst, place FROM b WHERE regexp_matches(target, '{web.PARTS}')),
s AS (SELECT {_NORMAL_URL.format(u='url')} AS url FROM pages),
ok AS (SELECT src, dst, min(place) AS place FROM e WHERE src <> dst AND len(list_filter([{_sql_list(web.BANNED)}], lambda x: contains(lower(dst), x))) = 0
  AND regexp_extract(dst, '{web.PARTS}', 2) IN (SELECT regexp_extract(url, '{web.PARTS}', 2) FROM pages) GROUP BY src, dst),
f AS (SELECT src, dst FROM ok QUALIFY row_number() OVER (PARTITION BY src ORDER BY place) <= 100)
SELECT url, 0::INTEGER AS depth FROM s GROUP BY url UNION ALL SELECT DISTINCT dst AS url, 1::INTEGER AS depth FROM f WHERE dst NOT IN (SELECT url FROM s)""")
def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return crawl.frontier(crawl.page_links(pages, None), pages.select(web.normal_url(F.col("url")).alias("url")), 1)


@query(r"SELECT url, regexp_replace(url, '[^\pL\pN]+', '_', 'g') AS name FROM pages")
def safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("url", tx.safe_name(F.col("url")).alias("name"))


# Sources and manifest.


@query("SELECT doc_id, sha256(text) AS sha256, 'text_input/' || sha256(text) || '.txt' AS path FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha256"), tx.text_path(F.col("text")).alias("path"))


@query("SELECT sha256(text) AS sha256, count(*)::BIGINT AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return rows.where("n > 1")


def _before_and_after(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A manifest and a scan of whole tables that differ by rules on ids: added, edited, removed, and of another model."""
    docs = _docs(spark, sf_dir).withColumn("path", F.concat(F.lit("/data/"), "file_name", F.lit("/"), "doc_id", F.lit(".txt")))
    old = docs.where("doc_id % 7 <> 0").select("path", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"), F.lit(0.0).alias("mtime"), "doc_id", F.when(F.col("doc_id") % 5 == 0, "old").otherwise("new").alias("model"))
    text = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = docs.where("doc_id % 13 <> 0").select("path", F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("long").alias("size"), F.lit(1.0).alias("mtime"))
    return old, new


_DIFF = """o AS (SELECT '/data/' || source || '/' || doc_id || '.txt' AS path, sha256(text) AS h, doc_id, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE 'new' END AS model FROM documents WHERE doc_id % 7 <> 0),
n AS (SELECT '/data/' || source || '/' || doc_id || '.txt' AS path, sha256(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 13 <> 0),
x AS (SELECT coalesce(n.path, o.path) AS path, o.doc_id, coalesce(n.h, o.h) AS sha256, CASE WHEN n.path IS NULL THEN 'missing' WHEN o.path IS NULL THEN 'new' WHEN n.h <> o.h THEN 'changed' WHEN o.model <> 'new' THEN 'model_changed' ELSE 'unchanged' END AS action FROM n FULL JOIN o ON n.path = o.path)"""


@query(f"WITH {_DIFF} SELECT path, coalesce(doc_id, -1)::BIGINT AS doc_id, sha256, action FROM x")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _before_and_after(spark, sf_dir)
    return mf.diff(new, old, "new").select("path", F.coalesce("doc_id", F.lit(-1)).cast("long").alias("doc_id"), "sha256", "action")


@query(f"WITH {_DIFF}, m AS (SELECT max(doc_id) AS m FROM o) SELECT count(*)::BIGINT AS n, count(DISTINCT sha256)::BIGINT AS hashes, max(CASE WHEN action = 'new' THEN m + (SELECT count(*) FROM x WHERE action = 'new') ELSE 0 END)::BIGINT AS last_id FROM x CROSS JOIN m WHERE action <> 'missing'")
def manifest_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _before_and_after(spark, sf_dir)
    after = mf.applied(old, mf.numbered(mf.diff(new, old, "new"), mf.next_id(old)), "new")
    return after.agg(F.count("*").alias("n"), F.countDistinct("sha256").alias("hashes"), F.max("doc_id").alias("last_id"))


@query(f"WITH {_POST.replace('FROM documents)', 'FROM documents WHERE doc_id % 10 <> 3)')} , dl AS (SELECT d.doc_id, count(p.tok) AS length FROM documents d LEFT JOIN post p ON d.doc_id = p.doc_id WHERE d.doc_id % 10 <> 3 GROUP BY d.doc_id) SELECT count(*)::BIGINT AS n_docs, round(avg(length), 6) AS avg_length FROM dl")
def delete_source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    left = ix.without(index, index.docs.where("doc_id % 10 = 3"))
    return left.corpus_stats.select("n_docs", F.round("avg_length", 6).alias("avg_length"))


@query(f"WITH {_CHUNKS} SELECT cut.doc_id, 'text_input/' || sha256(text) || '.txt' AS path, len(c)::BIGINT AS chunk_count, 'text' AS type FROM cut JOIN documents d ON cut.doc_id = d.doc_id")
def list_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    known = docs.select(tx.text_path(F.col("text")).alias("path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"), F.lit(0.0).alias("mtime"), "doc_id", F.lit("hashed-64").alias("model"))
    return mf.sources(known, ix.chunk_table(docs)).select("doc_id", "path", "chunk_count", "type")


_PATHS = "p AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'a/B.TXT' WHEN 1 THEN 'a/b.md' WHEN 2 THEN 'a/b.pdf' WHEN 3 THEN 'a/b.DOCX' WHEN 4 THEN 'a/b.html' WHEN 5 THEN 'https://x.example/a' WHEN 6 THEN 'text_input/ab.txt' ELSE 'a/b.xyz' END AS path FROM documents)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("a/B.TXT", "a/b.md", "a/b.pdf", "a/b.DOCX", "a/b.html", "https://x.example/a", "text_input/ab.txt", "a/b.xyz")
    return _docs(spark, sf_dir).select("doc_id", F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 8 + 1).cast("int")).alias("path"))


@query(f"WITH {_PATHS} SELECT doc_id, CASE WHEN starts_with(path, 'text_input/') THEN 'text' WHEN regexp_matches(path, '^https?://') THEN 'url' WHEN doc_id % 3 = 0 THEN 'file' ELSE 'file (missing)' END AS type FROM p")
def source_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("doc_id", mf.source_type(F.col("path"), F.col("doc_id") % 3 == 0).alias("type"))


@query(f"WITH {_PATHS} SELECT doc_id, CASE WHEN lower(path) LIKE '%.txt' THEN 'txt' WHEN lower(path) LIKE '%.md' THEN 'markdown' WHEN lower(path) LIKE '%.pdf' THEN 'pdf' WHEN lower(path) LIKE '%.docx' THEN 'docx' WHEN lower(path) LIKE '%.html' THEN 'html' WHEN path LIKE 'http%://%' THEN 'web' END AS handler FROM p")
def handler_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("doc_id", files.handler(F.col("path")).alias("handler"))


@query("SELECT DISTINCT 'text_input/' || sha256(text) || '.txt' AS path, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS size FROM documents WHERE trim(text) <> ''")
def text_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.from_texts(_docs(spark, sf_dir)).select("path", "sha256", "size")


_SCOPED = _DIFF.replace("FROM documents WHERE doc_id % 7 <> 0)", "FROM documents WHERE doc_id % 7 <> 0 AND starts_with(source, 'src1'))")


@query(f"WITH {_SCOPED} SELECT path, action FROM x")
def manifest_diff_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known sources are those under a folder."""
    old, new = _before_and_after(spark, sf_dir)
    return mf.diff(new, old, "new", scope="/data/src1").select("path", "action")


@query("SELECT coalesce(max(doc_id) + 1, 0)::BIGINT AS next_id FROM documents WHERE doc_id % 7 <> 0")
def manifest_next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = _before_and_after(spark, sf_dir)
    return spark.createDataFrame([(mf.next_id(old),)], "next_id long")


@query(f"WITH {_DIFF} SELECT doc_id, h AS sha256, CASE WHEN doc_id % 4 = 0 THEN 'stored' ELSE model END AS model FROM o WHERE doc_id % 9 <> 0")
def manifest_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = _before_and_after(spark, sf_dir)
    read = old.withColumns({"sha256": F.when(F.col("doc_id") % 9 != 0, F.col("sha256")), "model": F.when(F.col("doc_id") % 4 != 0, F.col("model"))})
    return mf.loaded(read, "stored").select("doc_id", "sha256", "model")


@query(f"WITH {_CHUNKS}, {_DIFF}, c AS (SELECT doc_id, string_agg(chunk_id::VARCHAR, ',' ORDER BY chunk_id) AS chunk_ids FROM chunk GROUP BY doc_id) SELECT o.doc_id, path, coalesce(chunk_ids, '') AS chunk_ids FROM o LEFT JOIN c ON o.doc_id = c.doc_id")
def manifest_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = _before_and_after(spark, sf_dir)
    rows = mf.stored(old, ix.chunk_table(_docs(spark, sf_dir)))
    return rows.select("doc_id", "path", F.coalesce(_joined("chunk_ids"), F.lit("")).alias("chunk_ids"))


@query(f"WITH {_DIFF} SELECT doc_id, path FROM o WHERE doc_id IN (SELECT doc_id FROM labels)")
def manifest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = _before_and_after(spark, sf_dir)
    return mf.paths_of(old, _table(spark, sf_dir, "labels"))


@query("SELECT DISTINCT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def has_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.has_docs(_index(spark, sf_dir), _table(spark, sf_dir, "labels").select("doc_id").distinct())


@query(f"WITH e AS (SELECT label, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS index_name, {_sql_norm('embedding')} AS norm FROM embeddings) SELECT index_name, count(*)::BIGINT AS n, round(sum(CASE WHEN norm > 0 THEN 1 ELSE 0 END), 6)::DOUBLE AS norms FROM e GROUP BY index_name")
def vector_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two named indexes of one table."""
    rows = _embeddings(spark, sf_dir)
    even, odd = (vectors.prepared(rows.where(F.col("doc_id") % 2 == k), 64, name) for k, name in enumerate(("even", "odd")))
    both = even.unionByName(odd).select("index_name", vf.norm(F.col("embedding")).alias("norm"))
    return both.groupBy("index_name").agg(F.count("*").alias("n"), F.round(F.sum("norm"), 6).alias("norms"))
