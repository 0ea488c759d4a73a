"""Queries that apply each training-data operator to its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.llm import bitsliced, bpe_automaton, chat_repair, collocations, decontaminate, html_crf, language_id, lm_scoring, pii, quality_rules, simhash, source_audit, trie_counts
from noteweave.sources.tables import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

#: The session setting that holds the key of the surrogates; the key used where it is unset protects nothing.
SECRET_CONF, TEST_SECRET = "spark.noteweave.pii.key", "for tests only"


def secret(spark: SparkSession) -> str:
    return spark.conf.get(SECRET_CONF, TEST_SECRET)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op2_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(spark, table(spark, sf_dir, "pages"), ["page_id", "url"])


def op3_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair(spark, table(spark, sf_dir, "conversations"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    scored = lm_scoring.score(spark, table(spark, sf_dir, "documents"), good)
    return scored.withColumns({c: F.round(c, 6) for c in ("target_loss", "background_loss", "score")})


def op5_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_counts.count_tokens(spark, table(spark, sf_dir, "documents"), PIECES)


def op6_bitsliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return bitsliced.top_k(spark, vectors, vectors.filter("vec_id % 50 = 0"))


def op7_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe_automaton.digest(bpe_automaton.round_trip(spark, docs, VOCABULARY))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_id.train(table(spark, sf_dir, "documents"))
    return language_id.identify_pages(spark, table(spark, sf_dir, "pages"), model)


def op10_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, secret(spark), count_col="n_entities")


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(spark, table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(spark, table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.verdicts(quality_rules.ledger(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_html_crf": op2_html_crf,
    "op3_chat_repair": op3_chat_repair,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_trie_counts": op5_trie_counts,
    "op6_bitsliced": op6_bitsliced,
    "op7_bpe_automaton": op7_bpe_automaton,
    "op8_pii_surrogates": op8_pii_surrogates,
    "op9_language_id": op9_language_id,
    "op10_cgk_decontamination": op10_cgk_decontamination,
    "op11_source_audit": op11_source_audit,
    "op12_collocations": op12_collocations,
    "op13_quality_rules": op13_quality_rules,
}

#: SQL expresses the exact search, the scores, the audit, the phrases and the rules. Fingerprints by XXH64, random walks, automata, trained
#: fields and keyed surrogates have no SQL twin; those are tested in tests/llm against brute force, and the trained ones
#: also by held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op6_bitsliced": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.turn, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM (SELECT *, row_number() OVER () AS turn FROM v WHERE vec_id % 50 = 0) a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY turn ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s) WHERE rank <= 5""",
    "op4_lm_scoring": """WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM t), v AS (SELECT count(DISTINCT word) AS n FROM e),
p AS (SELECT doc_id, word, coalesce(lag(word) OVER (PARTITION BY doc_id ORDER BY pos), '') AS prev FROM e),
c AS (SELECT prev, word, count(*) AS b, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS t FROM p GROUP BY prev, word),
s AS (SELECT prev, sum(t) AS t0, sum(b) AS b0 FROM c GROUP BY prev),
l AS (SELECT doc_id, ln(t0 + 4.0::DOUBLE) - ln(t + 4.0::DOUBLE / n) AS lt, ln(b0 + 4.0::DOUBLE) - ln(b + 4.0::DOUBLE / n) AS lb FROM p JOIN c USING (prev, word) JOIN s USING (prev) CROSS JOIN v)
SELECT d.doc_id, count(lt) AS n_tokens, round(avg(lt), 6) AS target_loss, round(avg(lb), 6) AS background_loss, round(avg(lt) - avg(lb), 6) AS score FROM documents d LEFT JOIN l USING (doc_id) GROUP BY d.doc_id""",
    "op11_source_audit": r"""WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lc FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
c AS (SELECT w.lang, w.source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d), v AS (SELECT lang, count(*) AS v, sum(lc)::HUGEINT AS ln FROM k GROUP BY lang),
t AS (SELECT g.lang, g.source, coalesce(any_value(v.v), 0) AS v, coalesce(any_value(v.ln), 0) AS ln, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
a AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (t.total + 2 * t.v) AS p, 1 + (1000000000::HUGEINT * (k.lc + 2)) // (t.ln + 2 * t.v) AS q
  FROM t JOIN k ON k.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
x AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM a WHERE n > 0 AND p > q),
y AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM a JOIN a b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
z AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(y.value, 0) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN y ON y.lang = g.lang AND y.source = g.source AND y.item = h.source),
u AS (SELECT * FROM x UNION ALL SELECT * FROM z)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u) WHERE part = 'pair' OR rank <= 10""",
    "op12_collocations": r"""WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, row, unnest(x) AS piece, generate_subscripts(x, 1) AS no FROM (SELECT lang, row, string_split_regex(t, '[.,;:!?\x0A-\x0D]') AS x FROM d)),
w AS (SELECT lang, row, no, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
s AS (SELECT lang, w[i] AS a1, w[i + 1] AS a2, w[i + 2] AS a3 FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
f1 AS (SELECT lang, a1 AS p, count(*) AS f FROM s GROUP BY ALL), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang),
f2 AS (SELECT lang, a1, a2, a1 || ' ' || a2 AS p, count(*) AS f FROM s WHERE a2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, a1, a2, a3, a1 || ' ' || a2 || ' ' || a3 AS p, count(*) AS f FROM s WHERE a3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, p, f AS a, 1 AS k, a1 AS one, a2 AS two FROM f2 WHERE f >= 10 UNION ALL SELECT lang, p, f, 1, a1, a2 || ' ' || a3 FROM f3 UNION ALL SELECT lang, p, f, 2, a1 || ' ' || a2, a3 FROM f3),
f AS (SELECT lang, p, f FROM f1 UNION ALL SELECT lang, p, f FROM f2),
x AS (SELECT c.lang, c.p, c.a, c.k, u.f AS l, v.f AS r, (1000000::HUGEINT * c.a * c.a) // (u.f::HUGEINT * v.f) AS score FROM c JOIN f u ON u.lang = c.lang AND u.p = c.one JOIN f v ON v.lang = c.lang AND v.p = c.two),
y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS turn FROM x) WHERE turn = 1),
z AS (SELECT lang, p, max(f) AS longer FROM (SELECT lang, a1 || ' ' || a2 AS p, f FROM f3 UNION ALL SELECT lang, a2 || ' ' || a3, f FROM f3) GROUP BY ALL)
SELECT lang, rank, p AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM (SELECT y.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM y LEFT JOIN z USING (lang, p) WHERE longer IS NULL OR 100 * longer < 50 * a) JOIN n USING (lang) WHERE rank <= 2000""",
    "op13_quality_rules": r"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT row, count(DISTINCT j) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS j FROM (SELECT row, i, count(*) OVER (PARTITION BY row, k) AS n FROM g) WHERE n > 1) GROUP BY row),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT), 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(l) AS n_lines, len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{L}'))) AS n_letterless,
  length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters FROM w LEFT JOIN r USING (row)),
f AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 10 * n_words)::INT + 8 * (100 * n_dup_lines > 50 * n_lines)::INT
  + 16 * (100 * n_upper > 50 * n_letters)::INT + 32 * (100 * n_letterless > 30 * n_words)::INT + 64 * (word_chars > 20 * n_words)::INT AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f""",
}
