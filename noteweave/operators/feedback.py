"""Relevance feedback: latest state, statistics, arms of an online test, training triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteweave.functions.text import percent

#: Thresholds (fixed values): rows in either arm, drop that rolls back, gain that promotes, trigger.
LEAST_ROWS, ROLLBACK, PROMOTE, TRIGGER = 10, 0.10, 0.02, 8
HIT5_FLOOR, HIT5_GATE, MRR_SLACK, EPS = 0.60, 0.85, 0.02, 1e-9


def latest(events: DataFrame, key: list[str], sequence: list[str]) -> DataFrame:
    """The last row of each key by the sequence; an aggregation, so a hot key is pre-aggregated."""
    rest = [c for c in events.columns if c not in key]
    last = events.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*sequence)).alias("r"))
    return last.select(*key, *(F.col(f"r.{c}").alias(c) for c in rest))


def totals(last: DataFrame, adopted: str = "adopted") -> DataFrame:
    n, good = F.count("*"), F.count_if(F.col(adopted))
    rate = F.when(n > 0, good / n).otherwise(0.0)
    return last.agg(n.alias("total"), good.alias("adopted"), (n - good).alias("rejected"), F.round(rate, 6).alias("rate"), percent(rate).alias("rate_text"))


def by_file(last: DataFrame, file: str, adopted: str = "adopted", blank: str = "(none)") -> DataFrame:
    name = F.when(F.coalesce(F.trim(F.col(file).cast("string")), F.lit("")) == "", blank).otherwise(F.col(file).cast("string"))
    return last.groupBy(name.alias("file")).agg(F.count_if(F.col(adopted)).alias("n_adopted"), F.count_if(~F.col(adopted)).alias("n_rejected"))


def top_files(last: DataFrame, file: str, n: int = 10) -> DataFrame:
    return by_file(last, file).orderBy(F.desc("n_adopted"), "file").limit(n).select("file", "n_adopted")


def enrich(events: DataFrame, served: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Events with the context of what was served; a context value that is not empty wins."""
    context = served.select(*key, *(F.col(f).alias(f"_{f}") for f in fields))
    pick = {f: F.coalesce(F.when(F.col(f"_{f}").cast("string") != "", F.col(f"_{f}")), F.col(f)) for f in fields}
    return events.join(context, key, "left").withColumns(pick).select(*events.columns)


def adoption(events: DataFrame, arm: Column, group: list[str], adopted: Column) -> DataFrame:
    """Rows and adoption rate of both arms (`arm`: true for the candidate) for each group."""
    base, cand = ~arm, arm
    rate = lambda test: F.when(F.count_if(test) > 0, F.count_if(test & adopted) / F.count_if(test)).otherwise(0.0)
    return events.groupBy(*group).agg(F.count_if(base).alias("n_base"), rate(base).alias("rate_base"), F.count_if(cand).alias("n_cand"), rate(cand).alias("rate_cand"))


def decide(arms: DataFrame) -> DataFrame:
    few = (F.col("n_base") < LEAST_ROWS) | (F.col("n_cand") < LEAST_ROWS)
    action = F.when(few, "keep").when(F.col("rate_cand") < F.col("rate_base") - ROLLBACK, "rollback").when(F.col("rate_cand") >= F.col("rate_base") + PROMOTE, "promote").otherwise("keep")
    return arms.withColumn("action", action)


def route(keys: DataFrame, key: str, ratio: float = 0.2) -> DataFrame:
    """Deterministic routing: the share `ratio` of all keys, by a hash, goes to the candidate."""
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 6), 16, 10).cast("long") % 10_000
    return keys.withColumn("bucket", bucket).withColumn("variant", F.when(bucket < int(ratio * 10_000), "candidate").otherwise("baseline"))


def gate(metrics: DataFrame) -> DataFrame:
    """Offline gate on columns hit5, mrr (candidate) and base_mrr."""
    passed = (F.col("hit5") >= HIT5_FLOOR - EPS) & (F.col("hit5") >= HIT5_GATE - EPS) & (F.col("mrr") >= F.col("base_mrr") - MRR_SLACK - EPS)
    return metrics.withColumn("passed", passed)


def triggered(last: DataFrame, adopted: str = "adopted") -> DataFrame:
    good = F.count_if(F.col(adopted))
    return last.agg(good.alias("positives"), (good >= TRIGGER).alias("triggered"))


def triples(judged: DataFrame, most: int = 3) -> DataFrame:
    """(`query`, `pos`, `neg`) from judged (`query`, `doc`, `adopted`): each positive with the query's first negatives.

    The cap of `most` negatives is the feature; they are the first by the hash of their name, a
    deterministic draw.
    """
    order = Window.partitionBy("query").orderBy(F.md5(F.col("doc").cast("string").cast("binary")), "doc")
    pairs = judged.select("query", "doc", "adopted").distinct()
    good = pairs.filter("adopted").select("query", F.col("doc").alias("pos"))
    bad = pairs.filter("not adopted").withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= most).select("query", F.col("doc").alias("neg"))
    return good.join(bad, "query").filter("pos <> neg")


def hard_negatives(ranking: DataFrame, gold: DataFrame, most: int = 3) -> DataFrame:
    """(`query_id`, `neg`, `turn`): the first ranked documents of each query that are not gold for it."""
    wrong = ranking.join(gold.select(F.col("query_id"), "doc_id"), ["query_id", "doc_id"], "left_anti")
    order = Window.partitionBy("query_id").orderBy("rank", "doc_id")
    return wrong.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= most).select("query_id", F.col("doc_id").alias("neg"), "turn")


def structural(chunked: DataFrame, most: int = 6, shortest: int = 40, cap: int = 400) -> DataFrame:
    """(`query`, `pos`) with the last title of a chunk's header path as the query.

    The first chunk of each query by a hash, then at most `most` of a file and `cap` in all.
    """
    title = F.trim(F.element_at(F.split("header_path", " > "), -1))
    fit = chunked.withColumn("query", title).filter((F.col("query") != "") & (F.length("text") >= shortest))
    drawn = fit.withColumn("h", F.md5(F.col("id").cast("binary")))
    first = drawn.withColumn("t", F.row_number().over(Window.partitionBy("query").orderBy("h", "id"))).filter("t = 1")
    few = first.withColumn("t", F.row_number().over(Window.partitionBy("source_file").orderBy("h", "id"))).filter(F.col("t") <= most)
    return few.orderBy("h", "id").limit(cap).select("query", F.col("id").alias("pos"))


def look_up(wanted: DataFrame, chunked: DataFrame) -> DataFrame:
    """`wanted` (`source_file`, `header_path`) with the `text` of that chunk, or of its file's first chunk where there is none.

    Each place is looked up once however many rows want it, and a popular place is not one task's: the rows meet
    the places found by a join whose hot keys are dealt out.
    """
    places = wanted.select("source_file", "header_path").distinct()
    files = places.select("source_file").distinct()
    held = chunked.join(files, "source_file", "left_semi")
    first = held.groupBy("source_file", "header_path").agg(F.min_by("text", "chunk_index").alias("own"))
    file = held.groupBy("source_file").agg(F.min_by("text", "chunk_index").alias("any"))
    found = places.join(first, ["source_file", "header_path"], "left").join(file, "source_file", "left")
    found = found.select("source_file", "header_path", F.coalesce("own", "any").alias("text"))
    salt, salts = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return wanted.withColumn("_s", salt).join(found.withColumn("_s", salts), ["source_file", "header_path", "_s"], "left").drop("_s")


#: Places that a key of a join is dealt to.
SALTS = 16
#: Chunks in a bucket from which negatives are drawn.
POOL = 64


def drawn(asked: DataFrame, chunked: DataFrame, most: int = 3) -> DataFrame:
    """`query` and `drawn`: up to `most` texts for each row of `asked` (`query`, `not_files`, `not_texts`) that it does not rule out.

    A draw by hashes, the same at any partitioning and without a comparison of all: chunks are dealt to buckets, each bucket keeps
    the POOL first by hash, and a query draws from the bucket of its own hash, in an order of its own.
    """
    buckets = max(1, chunked.count() // (4 * POOL))
    own = chunked.select("source_file", "text", F.md5(F.concat_ws("|", "source_file", "header_path", F.col("chunk_index").cast("string"))).alias("h"))
    turn = F.row_number().over(Window.partitionBy("bucket").orderBy("h", "text"))
    kept = own.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets))).withColumn("turn", turn).filter(F.col("turn") <= POOL)
    pools = kept.groupBy("bucket").agg(F.collect_list(F.struct("h", "source_file", "text")).alias("pool"))
    met = asked.withColumn("bucket", F.pmod(F.xxhash64("query"), F.lit(buckets))).join(pools, "bucket")
    fits = lambda c: ~F.exists("not_files", lambda f: c["source_file"].contains(f)) & ~F.array_contains("not_texts", c["text"])
    order = F.array_sort(F.transform(F.filter("pool", fits), lambda c: F.struct(F.md5(F.concat_ws("|", "query", c["h"])).alias("o"), c["text"].alias("text"))))
    return met.select("query", F.slice(F.array_distinct(F.transform(order, lambda x: x["text"])), 1, most).alias("drawn"))


def _with_negatives(pairs: DataFrame, chunked: DataFrame, most: int) -> DataFrame:
    """(`query`, `pos`, `neg`) from (`query`, `pos`, `negs`, `not_files`): the negatives there are, then drawn ones up to `most`."""
    few = pairs.filter(F.size("negs") < most)
    asked = few.groupBy("query").agg(F.array_distinct(F.flatten(F.collect_list("not_files"))).alias("not_files"), F.array_distinct(F.flatten(F.collect_list(F.array_append("negs", F.col("pos"))))).alias("not_texts"))
    filled = pairs.join(drawn(asked, chunked, most), "query", "left")
    every = F.slice(F.concat("negs", F.coalesce("drawn", F.array().cast("array<string>"))), 1, most)
    return filled.select("query", "pos", F.explode(every).alias("neg"))


def text_triples(judged: DataFrame, chunked: DataFrame, most: int = 3, fill: bool = True) -> DataFrame:
    """(`query`, `pos`, `neg`) as texts, from feedback (`query`, `source_file`, `header_path`, `adopted`, `timestamp`).

    Each adopted place with the first `most` places that were not adopted for its query, in the order of the log; fewer are filled up by
    a draw if `fill`. A place whose text is not found, and a negative that equals the positive, is left out.
    """
    rows = judged.filter(F.coalesce(F.col("source_file"), F.lit("")) != "").groupBy("query", "source_file", F.coalesce("header_path", F.lit("")).alias("header_path"), "adopted").agg(F.min("timestamp").alias("at"))
    texts = look_up(rows, chunked).filter("text is not null")
    turn = F.row_number().over(Window.partitionBy("query").orderBy("at", "source_file", "header_path"))
    bad = texts.filter("not adopted").withColumn("turn", turn).filter(F.col("turn") <= most)
    bad = bad.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("b")).select("query", F.transform("b", lambda x: x["text"]).alias("all"))
    good = texts.filter("adopted").select("query", F.col("text").alias("pos")).distinct().join(bad, "query", "left")
    negs = F.filter(F.coalesce("all", F.array().cast("array<string>")), lambda t: t != F.col("pos"))
    pairs = good.select("query", "pos", negs.alias("negs"), F.array().cast("array<string>").alias("not_files"))
    return _with_negatives(pairs, chunked, most) if fill else pairs.select("query", "pos", F.explode("negs").alias("neg"))


def case_triples(cases: DataFrame, chunked: DataFrame, found: DataFrame, most: int = 3) -> DataFrame:
    """(`query`, `pos`, `neg`) of cases (`query`, `gold`: a part of a file's name), with hard negatives first.

    The positive is one chunk of a gold file, by a hash; hard negatives are the first chunks of `found` (`query`, `rank`,
    `source_file`, `text`: what a search gives) of other files; a draw fills up.
    """
    files = chunked.select("source_file").distinct()
    gold = cases.join(files, F.col("source_file").contains(F.col("gold")))  # names of files against the stated cases
    draw = F.md5(F.concat_ws("|", "source_file", "header_path", F.col("chunk_index").cast("string")))
    pos = gold.join(chunked, "source_file").groupBy("query", "gold").agg(F.min_by("text", F.struct(draw, "text")).alias("pos"))
    wrong = found.join(cases, "query").filter(~F.col("source_file").contains(F.col("gold")))
    turn = F.row_number().over(Window.partitionBy("query", "gold").orderBy("rank", "text"))
    hard = wrong.join(pos, ["query", "gold"]).filter("text <> pos").withColumn("turn", turn).filter(F.col("turn") <= most)
    hard = hard.groupBy("query", "gold").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("h")).select("query", "gold", F.transform("h", lambda x: x["text"]).alias("hard"))
    pairs = pos.join(hard, ["query", "gold"], "left").select("query", "pos", F.coalesce("hard", F.array().cast("array<string>")).alias("negs"), F.array("gold").alias("not_files"))
    return _with_negatives(pairs, chunked, most)


def structural_triples(chunked: DataFrame, most: int = 6, shortest: int = 40, cap: int = 400, negatives: int = 1) -> DataFrame:
    """(`query`, `pos`, `neg`) with headings as queries, as `structural` draws them, and chunks of other files as negatives."""
    pairs = structural(chunked, most, shortest, cap).join(chunked.select(F.col("id").alias("pos"), "source_file", "text"), "pos")
    return _with_negatives(pairs.select("query", F.col("text").alias("pos"), F.array().cast("array<string>").alias("negs"), F.array("source_file").alias("not_files")), chunked, negatives)


def training_set(primary: DataFrame, *further: DataFrame, least: int = 30) -> DataFrame:
    """The triples of feedback, with those of further sources where there are fewer than `least`."""
    if primary.limit(least).count() >= least:
        return primary
    for more in further:
        primary = primary.unionByName(more)
    return primary


def positive_pairs(triples_: DataFrame) -> DataFrame:
    """(`query`, `pos`) without the negatives."""
    return triples_.select("query", "pos").distinct()


def newest(rows: DataFrame, order: list[str], keep: int = 800) -> DataFrame:
    """The `keep` rows inserted last: what a bounded cache holds. The bound is the feature."""
    return rows.orderBy(*(F.desc(c) for c in order)).limit(keep)
