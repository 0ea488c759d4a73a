"""All queries of the core library over the given tables, by name, with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteweave.functions.text import chunk_id, content_hash, doc_text, result_id
from noteweave.operators import audit, browse, evaluate, feedback, index, ingest, lsa, ranking, stored_index
from noteweave.sources.tables import shared_folder, staged, table
from noteweave.streaming import feedback as stream
from noteweave.streaming import keyed
from noteweave.streaming import table as buckets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

AS_OF = "2000-01-01"


def query(sql: str | None = None):
    """Register a function under its name, with its SQL twin."""

    def keep(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return keep


# --- shared pieces of the SQL twins --------------------------------------------------------------


def tok(text: str) -> str:
    """The tokeniser in DuckDB SQL."""
    z = f"regexp_replace({text}, '[^一-鿿]', '', 'g')"
    grams = f"flatten(list_transform(range(1, length({z})), lambda i: CASE WHEN i + 2 <= length({z}) THEN [substr({z}, i, 2), substr({z}, i, 3)] ELSE [substr({z}, i, 2)] END))"
    return f"list_concat(CASE WHEN length({z}) >= 2 THEN {grams} ELSE [] END, list_transform(regexp_extract_all({text}, '[a-zA-Z0-9]+'), lambda x: lower(x)))"


TOKENS = f"d AS (SELECT doc_id, tokens, len(tokens) AS dl FROM (SELECT doc_id, {tok('text')} AS tokens FROM documents))"
POSTS = f"{TOKENS}, p AS (SELECT doc_id, dl, term, count(*) AS freq FROM (SELECT doc_id, dl, unnest(tokens) AS term FROM d) GROUP BY ALL)"


def bm25_ctes(queries: str, name: str = "r", k: int = 50, keep: str = "true") -> str:
    """CTEs from postings to a ranking; `queries` is a SELECT of query_id, query."""
    return f"""q_{name} AS (SELECT DISTINCT query_id, unnest({tok('query')}) AS term FROM ({queries})),
s_{name} AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d), f_{name} AS (SELECT term, count(*) AS df FROM p GROUP BY term),
sc_{name} AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * freq * 2.5 / (freq + 1.5 * (0.25 + 0.75 * greatest(dl, 1) / avgdl))), 6) AS score
  FROM p JOIN f_{name} USING (term) JOIN q_{name} USING (term) CROSS JOIN s_{name} WHERE doc_id IN (SELECT doc_id FROM documents WHERE {keep}) GROUP BY query_id, doc_id),
{name} AS (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM sc_{name}) WHERE rank <= {k})"""


def cosine_ctes(queries: str, name: str = "v", k: int = 50, keep: str = "true") -> str:
    return f"""q_{name} AS (SELECT DISTINCT query_id, unnest({tok('query')}) AS term FROM ({queries})),
n_{name} AS (SELECT doc_id, sqrt(sum((ln(freq) + 1) * (ln(freq) + 1))) AS norm FROM p GROUP BY doc_id), z_{name} AS (SELECT query_id, sqrt(count(*)) AS size FROM q_{name} GROUP BY query_id),
sc_{name} AS (SELECT query_id, doc_id, round(any_value(dot) / (any_value(norm) * any_value(size)), 6) AS score FROM (SELECT query_id, doc_id, sum(ln(freq) + 1) AS dot FROM p JOIN q_{name} USING (term)
  WHERE doc_id IN (SELECT doc_id FROM documents WHERE {keep}) GROUP BY query_id, doc_id) JOIN n_{name} USING (doc_id) JOIN z_{name} USING (query_id) GROUP BY query_id, doc_id),
{name} AS (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM sc_{name}) WHERE rank <= {k})"""


def fused_ctes(wv: float = 1.0, ww: float = 1.0) -> str:
    return f"""fu AS (SELECT coalesce(v.query_id, r.query_id) AS query_id, coalesce(v.doc_id, r.doc_id) AS doc_id, v.rank AS vec_rank, r.rank AS kw_rank, v.score AS similarity, r.score AS bm25,
  round(coalesce(CAST({wv} AS DOUBLE) / (60 + v.rank), 0) + coalesce(CAST({ww} AS DOUBLE) / (60 + r.rank), 0), 9) AS fused FROM v FULL OUTER JOIN r ON v.query_id = r.query_id AND v.doc_id = r.doc_id),
h AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, vec_rank NULLS LAST, kw_rank NULLS LAST, doc_id) AS INTEGER) AS rank FROM fu)"""


ITEMS = "SELECT item_id AS query_id, text AS query FROM benchmark"


GOLD = "gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents x ON contains(x.text, b.text))"


def metric_cte(ranking: str, name: str) -> str:
    return f"""fh_{name} AS (SELECT g.query_id, min(rank) AS first FROM (SELECT DISTINCT query_id FROM gold) g LEFT JOIN (SELECT query_id, rank FROM {ranking} SEMI JOIN gold USING (query_id, doc_id)) USING (query_id) GROUP BY g.query_id),
{name} AS (SELECT count(*) AS n, round(coalesce(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END), 0), 6) AS hit1, round(coalesce(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 0), 6) AS hit5,
  round(coalesce(avg(CASE WHEN first <= 5 THEN CAST(1.0 AS DOUBLE) / first ELSE 0.0 END), 0), 6) AS mrr FROM fh_{name})"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# --- text and index ------------------------------------------------------------------------------


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {tok('text')} AS t FROM documents)")
def tokenize_docs(spark, sf_dir):
    toks = index.tokenised(table(spark, sf_dir, "documents"))
    return toks.select("doc_id", F.col("dl").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_distinct"))


@query("SELECT doc_id, md5(source || '|' || lang || '|' || substr(text, 1, 100)) AS chunk_id, sha256(text) AS content_hash, source || ' ' || lang || ' | ' || substr(text, 1, 40) AS doc_text FROM documents")
def chunk_identity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    shown = doc_text(F.col("source"), F.col("lang"), F.substring("text", 1, 40))
    return docs.select("doc_id", chunk_id(F.col("source"), F.col("lang"), F.col("text")).alias("chunk_id"), content_hash(F.col("text")).alias("content_hash"), shown.alias("doc_text"))


@query(f"WITH {POSTS} SELECT doc_id, term, freq FROM p")
def term_freq(spark, sf_dir):
    return index.postings(index.tokenised(table(spark, sf_dir, "documents"))).select("doc_id", "term", "freq")


@query(f"WITH {POSTS} SELECT term, count(*) AS df FROM p GROUP BY term")
def doc_freq(spark, sf_dir):
    toks = index.tokenised(table(spark, sf_dir, "documents"))
    return index.document_frequencies(toks.select("doc_id", F.explode(F.array_distinct("tokens")).alias("term")))


@query(f"WITH {TOKENS} SELECT count(*) AS n_docs, CAST(sum(dl) AS BIGINT) AS n_tokens, round(avg(dl), 6) AS avgdl FROM d")
def corpus_stats(spark, sf_dir):
    return index.corpus_stats(index.tokenised(table(spark, sf_dir, "documents"))).withColumn("avgdl", F.round("avgdl", 6))


@query(f"""WITH {TOKENS}, l0 AS (SELECT doc_id AS k, sha256(array_to_string(tokens, chr(0))) AS h FROM d),
l1 AS (SELECT CAST(floor(k / 1024) AS BIGINT) AS k, sha256(string_agg(h, chr(1) ORDER BY k, h)) AS h FROM l0 GROUP BY 1),
l2 AS (SELECT CAST(floor(k / 1024) AS BIGINT) AS k, sha256(string_agg(h, chr(1) ORDER BY k, h)) AS h FROM l1 GROUP BY 1)
SELECT CAST(floor(k / 1024) AS BIGINT) AS part, sha256(string_agg(h, chr(1) ORDER BY k, h)) AS digest FROM l2 GROUP BY 1""")
def corpus_digest(spark, sf_dir):
    return index.corpus_digest(index.tokenised(table(spark, sf_dir, "documents")))


# --- ranking -------------------------------------------------------------------------------------


@query(f"WITH {POSTS}, {bm25_ctes(ITEMS, k=10)} SELECT query_id, rank, doc_id, score FROM r")
def bm25_topk(spark, sf_dir):
    return ranking.bm25(table(spark, sf_dir, "documents"), items(spark, sf_dir), 10)


@query(f"WITH documents AS (SELECT doc_id, source || ' ' || lang || ' ' || text AS text FROM main.documents), {POSTS}, {bm25_ctes(ITEMS, k=10)} SELECT query_id, rank, doc_id, score FROM r")
def bm25_with_paths(spark, sf_dir):
    docs = ranking.with_paths(table(spark, sf_dir, "documents"), "source", "lang")
    return ranking.bm25(docs, items(spark, sf_dir), 10)


@query(f"WITH {POSTS}, {bm25_ctes(ITEMS, k=10)} SELECT r.query_id, r.doc_id, substr(md5(b.text || '|' || r.doc_id), 1, 12) AS result_id FROM r JOIN benchmark b ON b.item_id = r.query_id")
def result_ids(spark, sf_dir):
    asked = items(spark, sf_dir)
    found = ranking.bm25(table(spark, sf_dir, "documents"), asked, 10).join(asked, "query_id")
    return found.select("query_id", "doc_id", result_id(F.col("query"), F.col("doc_id")).alias("result_id"))


KNN = """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round({score}, 6) AS score FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) a CROSS JOIN embeddings b)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s) WHERE rank <= 10"""


@query(KNN.format(score="list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"))
def vector_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ranking.nearest(spark, vectors, vectors.filter("vec_id % 100 = 0"), 10)


@query(KNN.format(score="1 - list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"))
def legacy_similarity(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ranking.nearest(spark, vectors, vectors.filter("vec_id % 100 = 0"), 10, metric="l2")


def _fused(spark, sf_dir, wv, ww):
    docs, asked = table(spark, sf_dir, "documents"), items(spark, sf_dir)
    found = ranking.hits(ranking.fuse(*ranking.channels(docs, asked), wv, ww), 10)
    return found.select("query_id", "rank", "doc_id", F.col("fused").alias("fused_score"), "vec_rank", "kw_rank")


RRF = "WITH {posts}, {cos}, {bm}, {fu} SELECT query_id, rank, doc_id, fused AS fused_score, vec_rank, kw_rank FROM h WHERE rank <= 10"


@query(RRF.format(posts=POSTS, cos=cosine_ctes(ITEMS), bm=bm25_ctes(ITEMS), fu=fused_ctes()))
def rrf_fusion(spark, sf_dir):
    return _fused(spark, sf_dir, 1.0, 1.0)


@query(RRF.format(posts=POSTS, cos=cosine_ctes(ITEMS), bm=bm25_ctes(ITEMS), fu=fused_ctes(2.0, 1.0)))
def rrf_fusion_weighted(spark, sf_dir):
    return _fused(spark, sf_dir, 2.0, 1.0)


KEEP = "lang = 'en' AND contains(source, '1')"
HITS = "SELECT query_id, rank, doc_id, round_even(fused, 5) AS fused_score, round_even(similarity, 3) AS similarity, round_even(bm25, 3) AS bm25, lang, source, substr(text, 1, 200) AS excerpt FROM h JOIN documents USING (doc_id) WHERE rank <= 10"


def _search(spark, sf_dir, mode):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    keep = browse.matches({"lang": "en", "source": {"contains": "1"}})
    found = ranking.search(docs, items(spark, sf_dir), 10, keep, mode)
    return found.select("query_id", "rank", "doc_id", "fused_score", "similarity", "bm25", "lang", "source", "excerpt")


@query(f"WITH {POSTS}, {cosine_ctes(ITEMS, keep=KEEP)}, {bm25_ctes(ITEMS, keep=KEEP)}, {fused_ctes()} {HITS}")
def hybrid_search_filtered(spark, sf_dir):
    return _search(spark, sf_dir, "hybrid")


@query(f"WITH {POSTS}, {cosine_ctes(ITEMS, keep='false')}, {bm25_ctes(ITEMS, keep=KEEP)}, {fused_ctes()} {HITS}")
def bm25_only(spark, sf_dir):
    return _search(spark, sf_dir, "keyword")


@query(f"WITH {POSTS}, {cosine_ctes(ITEMS, keep=KEEP)}, {bm25_ctes(ITEMS, keep='false')}, {fused_ctes()} {HITS}")
def vector_only(spark, sf_dir):
    return _search(spark, sf_dir, "vector")


def _stored(spark, sf_dir) -> str:
    """An index of the documents as they once were, brought up to date: some changed, some gone, some new."""
    root = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    once = docs.filter("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 97 == 0, F.concat(F.lit("once "), "text")).otherwise(F.col("text")))
    gone = docs.filter("doc_id % 50 = 0").withColumn("doc_id", F.col("doc_id") + 100_000_000)
    stored_index.refresh(spark, root, once.unionByName(gone))
    stored_index.refresh(spark, root, docs)
    return root


@query(f"WITH {POSTS}, {bm25_ctes(ITEMS, k=10)} SELECT query_id, rank, doc_id, score FROM r")
def bm25_stored(spark, sf_dir):
    return stored_index.bm25(spark, _stored(spark, sf_dir), items(spark, sf_dir), 10)


@query(f"WITH {POSTS}, {cosine_ctes(ITEMS, keep=KEEP)}, {bm25_ctes(ITEMS, keep=KEEP)}, {fused_ctes()} {HITS}")
def search_stored(spark, sf_dir):
    keep = browse.matches({"lang": "en", "source": {"contains": "1"}})
    return stored_index.search(spark, _stored(spark, sf_dir), items(spark, sf_dir), 10, keep)


@query("SELECT CASE WHEN doc_id % 11 = 0 THEN 'insert' ELSE 'update' END AS action, count(*) AS n FROM documents WHERE doc_id % 11 = 0 OR doc_id % 97 = 0 GROUP BY 1 UNION ALL SELECT 'delete', count(*) FROM documents WHERE doc_id % 50 = 0 UNION ALL SELECT 'documents', count(*) FROM documents")
def index_refresh(spark, sf_dir):
    """What the second refresh changed, and how many documents the index then has."""
    root = _stored(spark, sf_dir)
    known = stored_index.manifest(spark, root)
    names = [s for s in spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/changes"))]
    last = max(names, key=lambda x: x.getModificationTime()).getPath().toString()
    done = spark.read.parquet(last).groupBy("action").agg(F.count("*").alias("n"))
    return done.unionByName(stored_index.documents(spark, root, known).agg(F.lit("documents").alias("action"), F.count("*").alias("n")))


@query(f"""WITH {POSTS}, {bm25_ctes(ITEMS)}, qt AS (SELECT query_id, list_distinct({tok('query')}) AS q FROM ({ITEMS})),
j AS (SELECT r.query_id, r.doc_id, r.rank AS pool_rank, CASE WHEN count(*) OVER (PARTITION BY r.query_id) > 10 THEN round(len(list_intersect(q, {tok('substr(text, 1, 512)')})) / greatest(len(q), 1), 6) END AS rerank_score
  FROM r JOIN qt USING (query_id) JOIN documents USING (doc_id))
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, pool_rank) AS INTEGER) AS rank, doc_id, rerank_score, pool_rank FROM j) WHERE rank <= 10""")
def rerank_lexical(spark, sf_dir):
    docs, asked = table(spark, sf_dir, "documents"), items(spark, sf_dir)
    return ranking.rerank(docs, asked, ranking.bm25(docs, asked), 10)


@query(f"""WITH {POSTS}, n AS (SELECT count(*) AS n FROM documents), t AS (SELECT term, count(*) AS df, sum(freq) AS total FROM p GROUP BY term ORDER BY total DESC, term LIMIT 50000),
w AS (SELECT doc_id, term, (ln(freq) + 1) * (ln((1.0 + n) / (df + 1.0)) + 1) AS w FROM p JOIN t USING (term) CROSS JOIN n), m AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id)
SELECT doc_id, term, round(w / norm, 6) AS weight FROM w JOIN m USING (doc_id)""")
def tfidf_weights(spark, sf_dir):
    return ranking.tfidf(table(spark, sf_dir, "documents")).withColumn("weight", F.round("weight", 6))


@query()
def lsa_similarity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows, vocabulary = lsa.numbered(docs, ranking.idf_table(docs))
    rows = staged(rows.withColumn("weights", F.col("weights").cast("array<float>")))
    vectors = staged(lsa.transform(spark, *lsa.aligned((rows, vocabulary), lsa.fit(spark, rows, vocabulary=vocabulary))))
    return ranking.nearest(spark, vectors, vectors.filter("vec_id % 100 = 0"), 5)


@query()
def search_latent(spark, sf_dir):
    """Hybrid search under a predicate with latent vectors of 32 components, documents and items folded in. A singular value decomposition has no SQL."""
    docs = table(spark, sf_dir, "documents")
    idf = staged(ranking.idf_table(docs))
    rows, vocabulary = lsa.numbered(docs, idf)
    model = lsa.fit(spark, staged(rows.select("numbers", F.col("weights").cast("array<float>"))), 32, vocabulary=vocabulary)
    return lsa.search(spark, docs, items(spark, sf_dir), idf, model, 10, browse.matches({"lang": "en"}))


# --- browsing ------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, source, n_chars, substr(text, 1, 300) AS excerpt FROM documents WHERE lang = 'en' AND contains(source, '1') AND contains(text, 'that') ORDER BY doc_id LIMIT 50")
def filter_docs(spark, sf_dir):
    return browse.browse(table(spark, sf_dir, "documents"), {"lang": "en", "source": {"contains": "1"}}, "that", 50)


@query("SELECT coalesce(lang, 'unknown') AS lang, count(*) AS n FROM documents GROUP BY 1")
def type_distribution(spark, sf_dir):
    return browse.type_distribution(table(spark, sf_dir, "documents"), "lang")


@query("SELECT count(*) AS n_chunks, count(DISTINCT source) AS n_files FROM documents")
def kb_stats(spark, sf_dir):
    return browse.stats(table(spark, sf_dir, "documents"), "source")


# --- ingest --------------------------------------------------------------------------------------


def conversation_notes(spark, sf_dir) -> DataFrame:
    """One markdown note for each turn: a heading for the conversation, one for the role, the text."""
    turns = table(spark, sf_dir, "conversations")
    body = F.concat(F.lit("# conv "), F.col("conv_id"), F.lit("\n## "), F.col("role"), F.lit("\n"), F.col("text"))
    return turns.select(F.concat(F.lit("conv/"), F.col("conv_id"), F.lit("/"), F.col("turn"), F.lit(".md")).alias("path"), body.alias("body"))


TURN = "SELECT 'conv/' || conv_id || '/' || turn || '.md' AS path, 'conv ' || conv_id AS h1, role AS h2, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS t FROM conversations"


@query(f"""WITH c AS ({TURN}) SELECT path AS source_file, CASE WHEN length(t) > 20 THEN h1 || ' > ' || h2 ELSE regexp_extract(path, '([^/]*)\\.md$', 1) END AS header_path, CAST(0 AS INTEGER) AS chunk_index,
CASE WHEN length(t) > 20 THEN md5(path || '|' || h1 || ' > ' || h2 || '|' || substr(t, 1, 100)) ELSE md5(path || '|full') END AS id FROM c""")
def section_chunks(spark, sf_dir):
    return ingest.chunks(conversation_notes(spark, sf_dir)).select("source_file", "header_path", F.col("chunk_index").cast("int").alias("chunk_index"), "id")


@query(f"WITH c AS ({TURN}) SELECT path, CAST(1 AS BIGINT) AS section, h1 AS header_path FROM c UNION ALL SELECT path, 2, h1 || ' > ' || h2 FROM c")
def heading_paths(spark, sf_dir):
    return ingest.sections(conversation_notes(spark, sf_dir)).filter("section > 0").select("path", "section", "header_path")


@query("SELECT c_custkey, 'fact' AS memory_type, lower(trim(c_mktsegment)) AS status, 'a|b ' || c_nationkey AS tags, c_name AS owner, '' AS expiry, 'Body of ' || c_custkey AS body FROM customer")
def frontmatter_parse(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    raw = F.concat(F.lit("---\nmemory_type: fact\nstatus: "), F.lower(F.trim("c_mktsegment")), F.lit("\ntags:\n  - a\n  - b "), F.col("c_nationkey"), F.lit("\nowner: \""), F.col("c_name"), F.lit("\"\nunknown: x\n---\nBody of "), F.col("c_custkey"))
    return ingest.front_matter(c.select("c_custkey", raw.alias("raw"))).select("c_custkey", "memory_type", "status", "tags", "owner", "expiry", "body")


def _mutated(docs: DataFrame) -> DataFrame:
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    changed = docs.filter(F.col("doc_id") % 11 != 0).select(F.when(F.col("doc_id") % 13 == 0, F.col("doc_id") + 100_000_000).otherwise(F.col("doc_id")).alias("id"), content_hash(text).alias("content_hash"))
    return changed


MUTATED = """o AS (SELECT doc_id AS id, sha256(text) AS h FROM documents), m AS (SELECT CASE WHEN doc_id % 13 = 0 THEN doc_id + 100000000 ELSE doc_id END AS id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || ' changed' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0)"""


@query(f"WITH {MUTATED} SELECT coalesce(o.id, m.id) AS id, CASE WHEN o.id IS NULL THEN 'insert' WHEN m.id IS NULL THEN 'delete' WHEN o.h <> m.h THEN 'update' ELSE 'keep' END AS action FROM o FULL OUTER JOIN m ON o.id = m.id")
def incremental_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return ingest.difference(docs.select(F.col("doc_id").alias("id"), content_hash(F.col("text")).alias("content_hash")), _mutated(docs))


@query(f"WITH {MUTATED} SELECT id, h AS content_hash FROM m")
def apply_upsert(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return ingest.upsert(docs.select(F.col("doc_id").alias("id"), content_hash(F.col("text")).alias("content_hash")), _mutated(docs))


# --- audit ---------------------------------------------------------------------------------------

ORDER_RULES = {"1-URGENT": ("o_clerk_note", "o_orderstatus"), "2-HIGH": ("o_clerk_note",)}
ALLOWED = ("O", "F")


def _orders(spark, sf_dir) -> DataFrame:
    """Orders as notes: the note is blank on every fifth, a date is misspelt on every ninth."""
    o = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", F.when(F.col("o_orderkey") % 5 == 0, " ").otherwise("x").alias("o_clerk_note"),
        F.when(F.col("o_orderkey") % 9 == 0, F.regexp_replace(day, "-", "/")).otherwise(day).alias("day"),
    )


ORDERS = "o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE 'x' END AS o_clerk_note, CASE WHEN o_orderkey % 9 = 0 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders)"
Q_REQUIRED = "SELECT 'A' AS dimension, 'missing_field' AS code, CAST(o_orderkey AS VARCHAR) AS file, 'o_clerk_note' AS detail FROM o WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND trim(o_clerk_note) = ''"
Q_ENUM = "SELECT 'A' AS dimension, 'bad_status' AS code, CAST(o_orderkey AS VARCHAR) AS file, o_orderstatus AS detail FROM o WHERE o_orderstatus NOT IN ('O', 'F')"
Q_DATES = "SELECT 'A' AS dimension, 'bad_date' AS code, CAST(o_orderkey AS VARCHAR) AS file, 'day=' || day AS detail FROM o WHERE NOT regexp_full_match(day, '\\d{4}-\\d{2}-\\d{2}')"
Q_STALE = f"""SELECT 'B' AS dimension, 'stale' AS code, CAST(o_orderkey AS VARCHAR) AS file, CAST(age AS VARCHAR) AS detail FROM (SELECT o_orderkey, o_orderpriority, date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') AS age FROM orders)
WHERE age > CASE o_orderpriority WHEN '1-URGENT' THEN 1000 WHEN '2-HIGH' THEN 1500 ELSE 2000 END"""
Q_SHORT = "SELECT 'D' AS dimension, 'short_body' AS code, CAST(doc_id AS VARCHAR) AS file, CAST(n AS VARCHAR) AS detail FROM (SELECT doc_id, length(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) AS n FROM documents) WHERE n < 50"


@query(f"WITH {ORDERS} {Q_REQUIRED}")
def audit_required_fields(spark, sf_dir):
    return audit.required_fields(_orders(spark, sf_dir), ORDER_RULES, "o_orderpriority", "o_orderkey")


@query(f"WITH {ORDERS} {Q_ENUM}")
def audit_enums(spark, sf_dir):
    return audit.not_in(_orders(spark, sf_dir), "o_orderstatus", ALLOWED, "o_orderkey", "bad_status")


@query(f"WITH {ORDERS} {Q_DATES}")
def audit_dates(spark, sf_dir):
    return audit.bad_dates(_orders(spark, sf_dir), ("day",), "o_orderkey")


CONFIDENCE = "CASE WHEN l_linenumber = 3 THEN 'high' WHEN l_linenumber = 4 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) ELSE '0.5' END"


@query(f"""SELECT 'A' AS dimension, CASE WHEN try_cast(c AS DOUBLE) IS NULL THEN 'not_numeric' ELSE 'out_of_range' END AS code, file, c AS detail FROM (SELECT l_orderkey || '/' || l_linenumber AS file, {CONFIDENCE} AS c FROM lineitem)
WHERE try_cast(c AS DOUBLE) IS NULL OR try_cast(c AS DOUBLE) NOT BETWEEN 0 AND 1""")
def audit_confidence(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    value = F.when(F.col("l_linenumber") == 3, "high").when(F.col("l_linenumber") == 4, F.col("l_quantity").cast("int").cast("string")).otherwise("0.5")
    return audit.bad_confidence(lines.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("file"), value.alias("c")), "c", "file")


@query("""SELECT 'A' AS dimension, 'expiry_before_update' AS code, CAST(l_orderkey AS VARCHAR) || '/' || l_linenumber AS file, strftime(l_shipdate, '%Y-%m-%d') AS detail FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_shipdate < o_orderdate + INTERVAL 30 DAY AND strftime(l_shipdate, '%Y-%m-%d') < strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d')""")
def audit_expiry(spark, sf_dir):
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), text(F.date_add("o_orderdate", 30)).alias("updated"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat_ws("/", "l_orderkey", "l_linenumber").alias("file"), text("l_shipdate").alias("expiry"))
    return audit.expiry_before_update(lines.join(o, "l_orderkey"), "expiry", "updated", "file")


@query(f"SELECT 'B' AS dimension, 'expired' AS code, l_orderkey || '/' || l_linenumber AS file, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS detail FROM lineitem WHERE CAST(l_shipdate AS DATE) < DATE '{AS_OF}' - INTERVAL 4 YEAR")
def audit_expired(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("file"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("expiry"))
    return audit.expired(lines, "expiry", "file", "1996-01-01")


@query(Q_STALE)
def audit_stale(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return audit.stale(o, "o_orderpriority", "day", "o_orderkey", AS_OF, {"1-URGENT": 1000, "2-HIGH": 1500}, 2000)


HREF = 'href="/([^"]*)"'
LINKS = f"""l AS (SELECT page_id AS file, unnest(regexp_extract_all(html, '{HREF}', 1)) AS target FROM pages),
k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(regexp_extract(html, '<title>(.*?)</title>', 1)), '[^\\s]+')) AS target FROM pages),
b AS (SELECT file, target FROM l WHERE target <> '' AND NOT EXISTS (SELECT 1 FROM k WHERE k.target = l.target OR ends_with(k.target, '/' || l.target)))"""


def _links(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, sf_dir, "pages")
    found = pages.select(F.col("page_id").alias("file"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("target"))
    title = F.lower(F.regexp_extract("html", "<title>(.*?)</title>", 1))
    return found, pages.select(F.explode(F.regexp_extract_all(title, F.lit("[^\\s]+"), F.lit(0))).alias("name")).distinct()


@query(f"WITH {LINKS} SELECT file, target FROM b")
def broken_links(spark, sf_dir):
    return audit.broken(*_links(spark, sf_dir))


@query(f"WITH {LINKS} SELECT target, count(*) AS refs, count(DISTINCT file) AS n_sources, min(file) AS first_source, count(DISTINCT file) > 3 AS more FROM b GROUP BY target")
def broken_link_summary(spark, sf_dir):
    return audit.broken_summary(audit.broken(*_links(spark, sf_dir)))


@query(Q_SHORT)
def audit_short_bodies(spark, sf_dir):
    return audit.short_bodies(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("SELECT source, sha256(text) AS h, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def audit_dup_names(spark, sf_dir):
    return audit.duplicate_names(table(spark, sf_dir, "documents").select("source", content_hash(F.col("text")).alias("h")), ("source", "h"))


@query("""SELECT doc_id, 'indexed_not_on_disk' AS code FROM labels WHERE doc_id % 13 = 0 UNION ALL SELECT doc_id, 'on_disk_not_indexed' FROM documents WHERE doc_id % 13 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def index_consistency(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("doc_id % 13 <> 0")
    return audit.index_consistency(table(spark, sf_dir, "labels"), docs, "doc_id")


@query(f"WITH {ORDERS}, i AS ({Q_REQUIRED} UNION ALL {Q_ENUM} UNION ALL {Q_DATES} UNION ALL {Q_STALE} UNION ALL {Q_SHORT}) SELECT coalesce(dimension, 'all') AS dimension, coalesce(code, 'all') AS code, count(*) AS n FROM i GROUP BY ROLLUP (dimension, code)")
def audit_counts(spark, sf_dir):
    parts = (audit_required_fields, audit_enums, audit_dates, audit_stale, audit_short_bodies)
    every = None
    for part in parts:
        every = part(spark, sf_dir) if every is None else every.unionByName(part(spark, sf_dir))
    return audit.counts(every)


TYPES = "CASE o_orderpriority WHEN '1-URGENT' THEN 'fact' WHEN '2-HIGH' THEN 'task_state' WHEN '3-MEDIUM' THEN '' WHEN '5-LOW' THEN 'navigation' ELSE 'bogus' END"
NOTES = f"""n AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN '模板/' ELSE 'notes/' END || o_orderkey || '.md' AS path, o_orderkey % 7 = 0 AS template, o_orderkey % 10 <> 0 AS fm, {TYPES} AS type, o_orderkey % 3 = 0 AS blank FROM orders),
a AS (SELECT 'A' AS dimension, 'no_front_matter' AS code, path AS file, '' AS detail FROM n WHERE NOT fm UNION ALL SELECT 'A', 'missing_type', path, '' FROM n WHERE fm AND NOT template AND type = ''
UNION ALL SELECT 'A', 'bad_type', path, type FROM n WHERE fm AND type = 'bogus' UNION ALL SELECT 'A', 'missing_field', path, 'memory_type' FROM n WHERE fm AND NOT template AND type = ''
UNION ALL SELECT 'A', 'missing_field', path, 'source' FROM n WHERE fm AND NOT template AND type = 'fact' AND blank UNION ALL SELECT 'A', 'missing_field', path, 'status' FROM n WHERE fm AND NOT template AND type = 'task_state')"""


def _order_notes(spark, sf_dir) -> DataFrame:
    """Orders as raw notes: every tenth without front matter, every third with a blank source, every seventh a template."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    path = F.concat(F.when(key % 7 == 0, "模板/").otherwise("notes/"), key, F.lit(".md"))
    body = F.concat(F.lit("See [[notes/"), key + 1, F.lit("]] and [["), key, F.lit("|this]]."))
    head = F.concat(F.lit("---\nmemory_type: "), F.expr(TYPES), F.lit("\nsource: "), F.when(key % 3 == 0, " ").otherwise("x"), F.lit("\ndate_updated: "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\n---\n"), body)
    return ingest.front_matter(o.select(path.alias("path"), F.when(key % 10 == 0, body).otherwise(head).alias("raw")))


@query(f"WITH {NOTES} SELECT * FROM a")
def audit_structure(spark, sf_dir):
    return audit.structure(_order_notes(spark, sf_dir))


@query(f"WITH {NOTES} SELECT count(*) AS files, count(*) FILTER (fm) AS with_front_matter, 2 * count(*) AS links FROM n")
def audit_coverage(spark, sf_dir):
    return audit.coverage(_order_notes(spark, sf_dir))


@query(f"WITH {NOTES} SELECT dimension, file, code, detail, CAST(turn AS INTEGER) AS turn, greatest(n - 30, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY file, code, detail) AS turn, count(*) OVER (PARTITION BY dimension) AS n FROM a) WHERE turn <= 30")
def audit_report(spark, sf_dir):
    return audit.report(audit.structure(_order_notes(spark, sf_dir)))


AUDIT_OF = "1999-01-01"
VAULT = f"""n AS (SELECT o_orderkey AS k, o_orderkey % 7 = 0 AS template, CASE WHEN o_orderkey % 7 = 0 THEN '模板/' ELSE 'notes/' END || (o_orderkey % 10) || '/' || o_orderkey || '.md' AS path, {TYPES} AS type,
  CASE WHEN o_orderkey % 11 = 0 THEN 'none' WHEN o_orderkey % 13 = 0 THEN 'bad' WHEN o_orderkey % 17 = 0 THEN 'empty' ELSE 'fm' END AS kind, CASE o_orderkey % 6 WHEN 0 THEN 'active' WHEN 1 THEN 'odd' ELSE '' END AS status,
  CASE o_orderkey % 8 WHEN 0 THEN 'high' WHEN 1 THEN '1.5' WHEN 2 THEN '0.5' ELSE '' END AS conf, CASE WHEN o_orderkey % 19 = 0 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, o_orderkey % 19 = 0 AS odd_day,
  CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate - INTERVAL 30 DAY, '%Y-%m-%d') ELSE '' END AS expiry, CAST(o_orderdate AS DATE) AS d, o_orderkey % 4 = 0 AS short FROM orders),
h AS (SELECT * FROM n WHERE kind = 'fm' AND NOT template), e AS (SELECT path FROM n WHERE k % 2 = 0), on_disk AS (SELECT path FROM n WHERE kind <> 'bad' AND NOT template AND NOT short),
i AS (SELECT 'A' AS dimension, 'no_front_matter' AS code, path AS file, '' AS detail FROM n WHERE kind IN ('none', 'empty') UNION ALL SELECT 'A', 'bad_front_matter', path, 'an inline list or map without end' FROM n WHERE kind = 'bad'
UNION ALL SELECT 'A', 'missing_type', path, '' FROM h WHERE type = '' UNION ALL SELECT 'A', 'bad_type', path, type FROM n WHERE kind = 'fm' AND type = 'bogus' UNION ALL SELECT 'A', 'missing_field', path, 'memory_type' FROM h WHERE type = ''
UNION ALL SELECT 'A', 'missing_field', path, 'source' FROM h WHERE type = 'fact' AND k % 3 = 0 UNION ALL SELECT 'A', 'missing_field', path, 'status' FROM h WHERE type = 'task_state' AND status = '' UNION ALL SELECT 'A', 'bad_status', path, status FROM h WHERE status = 'odd'
UNION ALL SELECT 'A', 'bad_date', path, 'date_updated=' || day FROM h WHERE odd_day UNION ALL SELECT 'A', 'not_numeric', path, conf FROM h WHERE conf = 'high' UNION ALL SELECT 'A', 'out_of_range', path, conf FROM h WHERE conf = '1.5'
UNION ALL SELECT 'A', 'expiry_before_update', path, expiry FROM h WHERE NOT odd_day AND expiry <> '' AND expiry < day UNION ALL SELECT 'B', 'expired', path, expiry FROM n WHERE kind = 'fm' AND expiry <> '' AND expiry < '{AUDIT_OF}'
UNION ALL SELECT 'B', 'stale', path, CAST(DATE '{AUDIT_OF}' - d AS VARCHAR) FROM n WHERE kind = 'fm' AND NOT odd_day AND DATE '{AUDIT_OF}' - d > CASE WHEN type = 'task_state' THEN 30 ELSE 180 END
UNION ALL SELECT 'C', 'broken_link', path, 'missing ' || (k % 50) FROM n WHERE kind <> 'bad' AND NOT short UNION ALL SELECT 'C', 'broken_link', path, 'notes/' || ((k + 1) % 10) || '/' || (k + 1) FROM n WHERE kind <> 'bad' AND NOT short AND k + 1 NOT IN (SELECT k FROM n WHERE NOT template)
UNION ALL SELECT 'D', 'short_body', path, '6' FROM n WHERE kind <> 'bad' AND short UNION ALL SELECT 'E', 'index', path, 'indexed_not_on_disk' FROM (FROM e EXCEPT FROM on_disk) UNION ALL SELECT 'E', 'index', path, 'on_disk_not_indexed' FROM (FROM on_disk EXCEPT FROM e))"""


def _vault(spark, sf_dir) -> DataFrame:
    """Orders as notes with every fault: missing, empty and unparsable front matter, templates, odd types, dates and states, short bodies."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    by = lambda n, values, rest: F.coalesce(*(F.when(k % n == i, v) for i, v in values.items()), F.lit(rest))
    day = lambda c, form="yyyy-MM-dd": F.date_format(c, form)
    path = F.concat(F.when(k % 7 == 0, "模板/").otherwise("notes/"), k % 10, F.lit("/"), k, F.lit(".md"))
    links = F.concat(F.lit("See [[notes/"), (k + 1) % 10, F.lit("/"), k + 1, F.lit("]] and [[missing "), k % 50, F.lit("|that]] or [[#here]] in a body that is long enough for it.\n"))
    body = F.when(k % 4 == 0, "Short.").otherwise(links)
    expiry = by(5, {0: day(F.date_add("o_orderdate", 30)), 1: day(F.date_sub("o_orderdate", 30))}, "")
    updated = F.when(k % 19 == 0, day("o_orderdate", "yyyy/MM/dd")).otherwise(day("o_orderdate"))
    fields = {"memory_type": F.expr(TYPES), "source": F.when(k % 3 == 0, "").otherwise("x"), "status": by(6, {0: "active", 1: "odd"}, ""), "confidence": by(8, {0: "high", 1: "1.5", 2: "0.5"}, ""), "date_updated": updated, "expiry": expiry}
    held = F.concat(F.lit("---\n"), *(F.concat(F.lit(f"{name}: "), value, F.lit("\n")) for name, value in fields.items()), F.lit("---\n"), body)
    raw = F.when(k % 11 == 0, body).when(k % 13 == 0, F.concat(F.lit("---\nmemory_type: [x\n---\n"), body)).when(k % 17 == 0, F.concat(F.lit("---\n---\n"), body)).otherwise(held)
    return ingest.front_matter(o.select("o_orderkey", path.alias("path"), raw.alias("raw")))


@query(f"WITH {VAULT} SELECT * FROM i")
def audit_run(spark, sf_dir):
    notes = staged(_vault(spark, sf_dir).drop("metadata"))
    return audit.run(notes, AUDIT_OF, notes.filter("o_orderkey % 2 = 0"))


@query("""WITH d AS (SELECT doc_id FROM documents WHERE doc_id % 17 <> 0 AND length(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) >= 50)
SELECT doc_id, 'indexed_not_on_disk' AS code FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM d) UNION ALL SELECT doc_id, 'on_disk_not_indexed' FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def audit_index(spark, sf_dir):
    path = F.concat(F.when(F.col("doc_id") % 17 == 0, "模板/").otherwise("notes/"), "doc_id")
    notes = audit.indexable(table(spark, sf_dir, "documents").withColumn("path", path), "path", "text")
    return audit.index_consistency(table(spark, sf_dir, "labels"), notes, "doc_id")


@query(f"WITH {LINKS}, s AS (SELECT target, file, count(*) AS n, row_number() OVER (PARTITION BY target ORDER BY file) AS turn FROM b GROUP BY target, file) SELECT target, CAST(sum(n) AS BIGINT) AS refs, string_agg(CAST(file AS VARCHAR), ', ' ORDER BY turn) FILTER (turn <= 3) AS sources, count(*) > 3 AS more FROM s GROUP BY target")
def broken_link_sources(spark, sf_dir):
    return audit.broken_sources(audit.broken(*_links(spark, sf_dir)))


# --- evaluation ----------------------------------------------------------------------------------


def _gold(spark, sf_dir) -> DataFrame:
    return ranking.gold_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("item_id", "query_id")


@query(f"WITH {POSTS}, {GOLD}, {bm25_ctes(ITEMS)}, {metric_cte('r', 'm')} SELECT n, hit1, hit5, mrr FROM m")
def retrieval_eval(spark, sf_dir):
    asked = items(spark, sf_dir)
    return evaluate.metrics(evaluate.first_hits(ranking.bm25(table(spark, sf_dir, "documents"), asked), _gold(spark, sf_dir), asked))


@query(f"WITH {GOLD} SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM gold)")
def gold_reachability(spark, sf_dir):
    items_ = table(spark, sf_dir, "benchmark")
    return evaluate.unreachable(items_, _gold(spark, sf_dir).withColumnRenamed("query_id", "item_id")).select("item_id")


@query("""WITH c AS (SELECT doc_id, source, text FROM (SELECT doc_id, source, text, h, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS turn FROM (SELECT doc_id, source, text, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents))
WHERE turn <= 50 // (SELECT count(DISTINCT source) FROM documents) + 1 ORDER BY h, doc_id LIMIT 50),
l AS (SELECT *, substr(list_filter(list_transform(string_split(text, chr(10))[2:], lambda x: trim(regexp_replace(x, '^[#\\-*\\s`]+', ''))), lambda x: length(x) >= 12)[1], 1, 44) AS head FROM c),
q AS (SELECT *, regexp_extract(head, '^(.{8}[^.!?;。！？；]*)[.!?;。！？；]', 1) AS cut FROM l)
SELECT doc_id, source AS gold, coalesce(trim(CASE WHEN length(cut) >= 8 THEN cut ELSE head END), trim(substr(text, 1, 44))) AS query FROM q""")
def self_cases(spark, sf_dir):
    return evaluate.self_cases(table(spark, sf_dir, "documents"), 50)


@query(f"""WITH {POSTS}, {GOLD}, {bm25_ctes(ITEMS)}, {cosine_ctes(ITEMS)}, {fused_ctes()}, {metric_cte('r', 'a')}, {metric_cte('v', 'b')}, {metric_cte('h', 'c')}
SELECT candidate, x.hit5, x.mrr, a.mrr AS base_mrr, round(x.mrr - a.mrr, 4) AS delta_mrr, x.hit5 >= 0.85 - 1e-9 AND x.mrr >= a.mrr - 0.02 - 1e-9 AS passed FROM (SELECT 'vector' AS candidate, * FROM b UNION ALL SELECT 'hybrid', * FROM c UNION ALL SELECT 'same', * FROM a) x CROSS JOIN a""")
def offline_gate(spark, sf_dir):
    """Vector and hybrid search, and the keyword search itself, against keyword search."""
    docs, asked, gold = table(spark, sf_dir, "documents"), items(spark, sf_dir), _gold(spark, sf_dir)
    vector, keyword = ranking.channels(docs, asked)
    fused = ranking.hits(ranking.fuse(vector, keyword), 2 * ranking.POOL).select("query_id", "rank", "doc_id")
    measured = lambda found: evaluate.metrics(evaluate.first_hits(found, gold, asked))
    base = measured(keyword)
    rows = measured(vector).select(F.lit("vector").alias("candidate"), "hit5", "mrr").unionByName(measured(fused).select(F.lit("hybrid").alias("candidate"), "hit5", "mrr")).unionByName(base.select(F.lit("same").alias("candidate"), "hit5", "mrr"))
    judged = feedback.gate(rows.crossJoin(base.select(F.col("mrr").alias("base_mrr"))))  # one row
    return judged.select("candidate", "hit5", "mrr", "base_mrr", F.round(F.col("mrr") - F.col("base_mrr"), 4).alias("delta_mrr"), "passed")


# --- feedback ------------------------------------------------------------------------------------


def _feedback(spark, sf_dir) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    adopted = F.col("event_type").isin("purchase", "signup")
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", k.alias("k"), adopted.alias("adopted"), F.concat(F.lit("file"), k % 10).alias("file"))


EVENTS = "e AS (SELECT event_id, ts, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type IN ('purchase', 'signup') AS adopted, 'file' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 10) AS file FROM events)"
LATEST = f"{EVENTS}, l AS (SELECT * EXCLUDE (turn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_id DESC) AS turn FROM e) WHERE turn = 1)"


def _latest(spark, sf_dir) -> DataFrame:
    return feedback.latest(_feedback(spark, sf_dir), ["user_id", "k"], ["ts", "event_id"])


@query(f"WITH {LATEST} SELECT user_id, k, event_id, adopted FROM l")
def feedback_latest(spark, sf_dir):
    return _latest(spark, sf_dir).select("user_id", "k", "event_id", "adopted")


@query(f"WITH {LATEST} SELECT count(*) AS total, count(*) FILTER (adopted) AS adopted, count(*) FILTER (NOT adopted) AS rejected, round(count(*) FILTER (adopted) / count(*), 6) AS rate, printf('%.1f%%', 100.0 * count(*) FILTER (adopted) / count(*)) AS rate_text FROM l")
def feedback_stats(spark, sf_dir):
    return feedback.totals(_latest(spark, sf_dir))


@query(f"WITH {LATEST} SELECT file, count(*) FILTER (adopted) AS n_adopted, count(*) FILTER (NOT adopted) AS n_rejected FROM l GROUP BY file")
def feedback_by_file(spark, sf_dir):
    return feedback.by_file(_latest(spark, sf_dir), "file")


@query(f"WITH {LATEST} SELECT file, count(*) FILTER (adopted) AS n_adopted FROM l GROUP BY file ORDER BY n_adopted DESC, file LIMIT 5")
def top_adopted_files(spark, sf_dir):
    return feedback.top_files(_latest(spark, sf_dir), "file", 5)


@query(f"WITH {EVENTS} SELECT event_id, user_id, coalesce(CASE WHEN c_name <> '' THEN c_name END, file) AS file FROM e LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 2 = 0")
def feedback_enrich(spark, sf_dir):
    served = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("file"))
    return feedback.enrich(_feedback(spark, sf_dir).select("event_id", "user_id", "file"), served, ["user_id"], ["file"])


STARTED = "2024-01-01 00:00:00"
ARMS = f"{EVENTS}, a AS (SELECT user_id, count(*) FILTER (k >= 90) AS n_base, coalesce(count(*) FILTER (k >= 90 AND adopted) / nullif(count(*) FILTER (k >= 90), 0), 0) AS rate_base, count(*) FILTER (k < 90) AS n_cand, coalesce(count(*) FILTER (k < 90 AND adopted) / nullif(count(*) FILTER (k < 90), 0), 0) AS rate_cand FROM e WHERE strftime(ts, '%Y-%m-%d %H:%M:%S') >= '{STARTED}' GROUP BY user_id)"


def _arms(spark, sf_dir) -> DataFrame:
    rows = _feedback(spark, sf_dir).filter(F.date_format("ts", "yyyy-MM-dd HH:mm:ss") >= STARTED)
    return feedback.adoption(rows, F.col("k") < 90, ["user_id"], F.col("adopted"))


@query(f"WITH {ARMS} SELECT user_id, n_base, round(rate_base, 6) AS rate_base, n_cand, round(rate_cand, 6) AS rate_cand FROM a")
def adoption_by_arm(spark, sf_dir):
    return _arms(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("rate_base", "rate_cand")})


@query(f"WITH {ARMS} SELECT user_id, CASE WHEN n_base < 10 OR n_cand < 10 THEN 'keep' WHEN rate_cand < rate_base - CAST(0.1 AS DOUBLE) THEN 'rollback' WHEN rate_cand >= rate_base + CAST(0.02 AS DOUBLE) THEN 'promote' ELSE 'keep' END AS action FROM a")
def ab_decision(spark, sf_dir):
    return feedback.decide(_arms(spark, sf_dir)).select("user_id", "action")


@query("SELECT user_id, b AS bucket, CASE WHEN b < 2000 THEN 'candidate' ELSE 'baseline' END AS variant FROM (SELECT DISTINCT user_id, CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 6)) AS BIGINT) % 10000 AS b FROM events)")
def traffic_routing(spark, sf_dir):
    return feedback.route(table(spark, sf_dir, "events").select("user_id").distinct(), "user_id")


@query(f"""WITH {LATEST}, j AS (SELECT DISTINCT user_id AS query, k AS doc, adopted FROM l), n AS (SELECT query, doc AS neg FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY md5(CAST(doc AS VARCHAR)), doc) AS turn FROM j WHERE NOT adopted) WHERE turn <= 3)
SELECT p.query, p.doc AS pos, n.neg FROM j p JOIN n USING (query) WHERE p.adopted AND p.doc <> n.neg""")
def training_triples(spark, sf_dir):
    return feedback.triples(_latest(spark, sf_dir).select(F.col("user_id").alias("query"), F.col("k").alias("doc"), "adopted"))


@query(f"WITH {POSTS}, {GOLD}, {bm25_ctes(ITEMS, k=20)} SELECT query_id, neg, turn FROM (SELECT query_id, doc_id AS neg, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS INTEGER) AS turn FROM r ANTI JOIN gold USING (query_id, doc_id)) WHERE turn <= 3")
def hard_negatives(spark, sf_dir):
    found = ranking.bm25(table(spark, sf_dir, "documents"), items(spark, sf_dir), 20)
    return feedback.hard_negatives(found, _gold(spark, sf_dir))


@query("""WITH c AS (SELECT doc_id, source, source || ' > ' || lang || ' ' || (doc_id % 97) AS header, text, md5(CAST(doc_id AS VARCHAR)) AS id FROM documents WHERE length(text) >= 40),
f AS (SELECT *, md5(id) AS h, lang_q AS query FROM (SELECT *, trim(split_part(header, ' > ', 2)) AS lang_q FROM c)),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY h, id) AS t FROM f) WHERE t = 1), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, id) AS t2 FROM a) WHERE t2 <= 6)
SELECT query, id AS pos FROM b ORDER BY h, id LIMIT 400""")
def structural_triples(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    header = F.concat(F.col("source"), F.lit(" > "), F.col("lang"), F.lit(" "), F.col("doc_id") % 97)
    chunked = docs.select(F.md5(F.col("doc_id").cast("string").cast("binary")).alias("id"), F.col("source").alias("source_file"), header.alias("header_path"), "text")
    return feedback.structural(chunked)


@query("""WITH c AS (SELECT source AS source_file, lang AS header_path, arg_min(text, doc_id) AS own FROM documents GROUP BY ALL), f AS (SELECT source AS source_file, arg_min(text, doc_id) AS any_ FROM documents GROUP BY source)
SELECT e.event_id, sha256(coalesce(own, any_, '')) AS h FROM (SELECT event_id, s.source AS source_file, CASE WHEN event_id % 2 = 0 THEN 'en' ELSE 'none' END AS header_path FROM events JOIN (SELECT source, row_number() OVER (ORDER BY source) - 1 AS n FROM (SELECT DISTINCT source FROM documents)) s ON user_id % 5 = n) e LEFT JOIN c USING (source_file, header_path) LEFT JOIN f USING (source_file)""")
def feedback_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("source_file"), F.col("lang").alias("header_path"), F.col("doc_id").alias("chunk_index"), "text")
    names = docs.select("source_file").distinct().withColumn("n", F.row_number().over(Window.orderBy("source_file")) - 1)  # a few sources
    asked = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).cast("int").alias("n"), F.when(F.col("event_id") % 2 == 0, "en").otherwise("none").alias("header_path"))
    return feedback.look_up(asked.join(names, "n").drop("n"), docs).select("event_id", content_hash(F.col("text")).alias("h"))


JUDGED = f"""{EVENTS}, j AS (SELECT CAST(user_id AS VARCHAR) AS query, 'src' || (k % 20) AS source_file, CASE k % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' WHEN 3 THEN 'es' ELSE 'none' END AS header_path, adopted, min(event_id) AS since FROM e GROUP BY ALL),
c AS (SELECT source AS source_file, lang AS header_path, arg_min(text, doc_id) AS own FROM documents GROUP BY ALL), f AS (SELECT source AS source_file, arg_min(text, doc_id) AS any_ FROM documents GROUP BY source),
t AS (SELECT j.*, coalesce(own, any_) AS text FROM j LEFT JOIN c USING (source_file, header_path) LEFT JOIN f USING (source_file) WHERE coalesce(own, any_) IS NOT NULL)"""


@query(f"""WITH {JUDGED}, n AS (SELECT query, text AS neg FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY since, source_file, header_path) AS turn FROM t WHERE NOT adopted) WHERE turn <= 3)
SELECT p.query, sha256(p.pos) AS pos, sha256(n.neg) AS neg FROM (SELECT DISTINCT query, text AS pos FROM t WHERE adopted) p JOIN n USING (query) WHERE p.pos <> n.neg""")
def triples_with_texts(spark, sf_dir):
    """Places that users took or left, with their texts; no draws, which SQL cannot repeat."""
    lang = F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es", "none"))), (F.col("k") % 5 + 1).cast("int"))
    judged = _feedback(spark, sf_dir).select(F.col("user_id").cast("string").alias("query"), F.concat(F.lit("src"), F.col("k") % 20).alias("source_file"), lang.alias("header_path"), "adopted", F.col("event_id").alias("timestamp"))
    chunked = table(spark, sf_dir, "documents").select(F.col("source").alias("source_file"), F.col("lang").alias("header_path"), F.col("doc_id").alias("chunk_index"), "text")
    found = feedback.text_triples(judged, chunked, 3, fill=False)
    return found.select("query", content_hash(F.col("pos")).alias("pos"), content_hash(F.col("neg")).alias("neg"))


@query(f"""WITH {EVENTS}, s AS (SELECT user_id, ts AS at, 'shown ' || k AS file FROM e JOIN (SELECT event_id FROM events WHERE event_type IN ('view', 'click')) USING (event_id))
SELECT event_id, coalesce(s.file, e.file) AS file, s.at IS NOT NULL AS matched FROM (SELECT e.* FROM e JOIN (SELECT event_id FROM events WHERE event_type IN ('purchase', 'signup')) USING (event_id)) e LEFT JOIN s ON s.user_id = e.user_id AND s.at <= e.ts AND s.at >= e.ts - INTERVAL 6 HOUR""")
def served_feedback(spark, sf_dir):
    """Purchases and signups with what the user was shown in the six hours before: the table form of the join of two streams."""
    rows = _feedback(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    shown = rows.filter("event_type in ('view', 'click')").select("user_id", F.col("ts").alias("at"), F.concat(F.lit("shown "), "k").alias("file"))
    given = rows.filter("event_type in ('purchase', 'signup')").select("event_id", "user_id", "ts", "file")
    return keyed.served(given, shown, ["user_id"], ["file"], "ts", "at", "6 hours").select("event_id", "file", "matched")


@query(f"WITH {LATEST} SELECT user_id, k, event_id, adopted FROM l")
def feedback_keyed_state(spark, sf_dir):
    """The latest state by keyed state, as a stream of updates into a table by buckets."""
    events = table(spark, sf_dir, "events")
    source = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    k = F.get_json_object("props", "$.k").cast("long")
    rows = source.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", k.alias("k"), F.col("event_type").isin("purchase", "signup").alias("adopted"))
    root = f"{shared_folder(spark)}/keyed-{uuid.uuid4().hex}"
    updates = keyed.latest(rows, ["user_id", "k"], ["ts", "event_id"], "ts")
    buckets.sink(updates, f"{root}/rows", f"{root}/log", ["user_id", "k"], ["ts", "event_id"], mode="update", gone="expired").awaitTermination()
    return buckets.read(spark, f"{root}/rows").select("user_id", "k", "event_id", "adopted")


@query(f"WITH {LATEST} SELECT user_id, k, event_id, adopted FROM l")
def feedback_upserts(spark, sf_dir):
    """The latest state by upserts of four batches, one of them twice."""
    rows = _feedback(spark, sf_dir).select("user_id", "k", "ts", "event_id", "adopted")
    root = f"{shared_folder(spark)}/upserts-{uuid.uuid4().hex}"
    for batch in (0, 1, 2, 2, 3):
        buckets.apply(root, rows.filter(F.col("event_id") % 4 == batch), ["user_id", "k"], ["ts", "event_id"], "events", batch)
    return buckets.read(spark, root).select("user_id", "k", "event_id", "adopted")


@query(f"WITH {LATEST} SELECT count(*) FILTER (adopted) AS positives, count(*) FILTER (adopted) >= 8 AS triggered FROM l")
def loop_trigger(spark, sf_dir):
    return feedback.triggered(_latest(spark, sf_dir))


@query(f"WITH {LATEST} SELECT user_id, k, event_id, adopted FROM l")
def feedback_stream(spark, sf_dir):
    """The latest state again, from the events as a file stream that is read to its end."""
    events = table(spark, sf_dir, "events")
    source = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    k = F.get_json_object("props", "$.k").cast("long")
    rows = source.select("event_id", "ts", "user_id", k.alias("k"), F.col("event_type").isin("purchase", "signup").alias("adopted"))
    last = stream.latest(rows, ["user_id", "k"], ["ts", "event_id"], ["event_id", "adopted"])
    where = f"{shared_folder(spark)}/feedback-{uuid.uuid4().hex}"
    return stream.drain(last, f"{where}/log", f"{where}/rows").select("user_id", "k", "event_id", "adopted")
