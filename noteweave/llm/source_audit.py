"""Source divergence audit: how far each source's words stand from other sources' and from its language's.

A term is a run of ASCII letters (in lower case) and other characters beyond ASCII. Within a language the V terms
of at least `least` documents are kept; a group (language, source) or a language with N occurrences of kept terms gives a
term of count c the share p = 1 + floor(10^9 * (c + 2) / (N + 2 V)), and two shares p and q diverge by
f = floor((p - q)^2 / (p + q)). All of it is integer arithmetic.

Part `term`, the k terms by which a group stands out, goes by a dominance skyband. f grows with p and falls with q where
p > q, p grows with the group's count and q with the language's, so a term is never among the first k if k
others have a count in the group as high, a count in the language as low and an earlier place in UTF-8 order. Each partition
of the counts keeps its terms with fewer than k such dominators, the skybands are merged by the same rule, and what
is left is ranked by exact values. Neither N nor V is needed before the last step, and a task holds no more than BUFFERED rows
of a group before it prunes.

Part `pair` sums f over all kept terms for each two sources of a language. Terms that neither source has add the same value
each; a term that one has adds a value of that source's count and the other's share of nothing, so a histogram of counts is enough; only
terms that both have need both counts. Those are summed in tasks by blocks of BLOCK sources, and only sums are shuffled.

Texts are read once and counted before anything is shuffled: what is shuffled is one row for each term of a group and task
(or each HELD of them).

Defined results: null texts, languages and sources are read as ''; a document is a row, so repeated rows count again; every
group that occurs has its pairs, a language of one source none; without kept terms all pair values are 0 and no term is
ranked; ties go to the item that is earlier in UTF-8 order; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteweave.llm.common import prepare, small_batches, spread_join, stored

#: Documents that a kept term needs in its language, and ranks of part `term`.
LEAST, RANKS = 10, 10
#: Different terms of a task before their counts are passed on; rows of a group before a skyband is pruned; sources in a block.
HELD, BUFFERED, BLOCK = 200_000, 4096, 512
SCALE = 1_000_000_000

#: A-Z in lower case, other ASCII characters that are no letters as spaces.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """`lang`, `source`, `term`, `n` occurrences and `docs`, partial: several rows of one term and group can come."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_docs) in held.items():
                terms = list(n)
                for cut in range(0, len(terms), 20_000):
                    part = terms[cut : cut + 20_000]
                    columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string())]
                    columns += [pa.array([c[t] for t in part], pa.int64()) for c in (n, in_docs)]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in small_batches(batches, "t"):
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "t"))):
                n, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                found = text.translate(FOLD).split()
                n.update(found)
                in_docs.update(set(found))
                size += len(n) - before
            if size > HELD:
                yield from flush()
                size = 0
        yield from flush()

    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, text_col: str, lang_col: str, source_col: str, least: int) -> DataFrame:
    """`lang`, `source`, `term`, `n`, `lang_n` of the kept terms, and `heads`: 1 in one row of each term of a language, else 0."""
    partial = term_counts(docs, text_col, lang_col, source_col).repartition("lang", "term")  # one exchange for both sums
    each = partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    each = each.withColumns({"lang_n": F.sum("n").over(whole), "lang_docs": F.sum("docs").over(whole), "first": F.min("source").over(whole)})
    return each.filter(F.col("lang_docs") >= least).select("lang", "source", "term", "n", "lang_n", (F.col("first") == F.col("source")).cast("long").alias("heads"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """The share p of a count, exact; null where nothing is kept."""
    whole = (total + 2 * terms).cast("decimal(20,0)")
    scaled = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(whole > 0, F.lit(1).cast("long") + F.call_function("div", scaled, whole).cast("long"))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def dominated(terms: list[bytes], high: np.ndarray, low: np.ndarray, k: int) -> np.ndarray:
    """The places of the k-skyband: terms with fewer than k others as high in `high`, as low in `low` and earlier.

    Of equal counts only the first k terms can be in it; on what is left the dominators of each are counted.
    """
    order = np.array(sorted(range(len(terms)), key=terms.__getitem__), np.int64)
    a, b = high[order], low[order]
    alike = np.lexsort((np.arange(len(order)), b, a))
    new = np.concatenate([[True], (a[alike][1:] != a[alike][:-1]) | (b[alike][1:] != b[alike][:-1])]) if len(alike) else np.zeros(0, bool)
    starts = np.maximum.accumulate(np.where(new, np.arange(len(alike)), 0))
    few = np.sort(alike[np.arange(len(alike)) - starts < k])
    order, a, b = order[few], a[few], b[few]
    keep = np.zeros(len(order), bool)
    for cut in range(0, len(order), 512):
        end = min(cut + 512, len(order))
        before = np.arange(end) < np.arange(cut, end)[:, None]
        keep[cut:end] = (before & (a[:end] >= a[cut:end, None]) & (b[:end] <= b[cut:end, None])).sum(axis=1) < k
    return order[keep]


def skyband(rows: DataFrame, k: int) -> DataFrame:
    """The rows (`lang`, `source`, `term`, `n`, `lang_n`) that each partition's own k-skyband of a group holds."""
    schema = "lang string, source string, term string, n long, lang_n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list] = {}  # group: [terms, counts, counts in the language, size after the last prune]
        waiting: list[pa.RecordBatch] = []

        def prune(own: list) -> None:
            high, low = np.concatenate(own[1]), np.concatenate(own[2])
            left = dominated(own[0], high, low, k)
            own[:] = [[own[0][i] for i in left], [high[left]], [low[left]], len(left)]

        def take() -> None:
            table = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            langs, sources = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
            key = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            terms = table.column("term").cast(pa.binary()).combine_chunks()
            n, lang_n = (table.column(c).to_numpy() for c in ("n", "lang_n"))
            for at in np.split(order, cuts):
                group = (langs[int(at[0])].as_py(), sources[int(at[0])].as_py())
                own = held.setdefault(group, [[], [], [], 0])
                own[0] += terms.take(pa.array(at)).to_pylist()
                own[1].append(n[at])
                own[2].append(lang_n[at])
                if len(own[0]) > BUFFERED + 2 * own[3]:
                    prune(own)

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in held.items():
                prune(own)
                many = len(own[0])
                columns = [pa.array([lang] * many, pa.string()), pa.array([source] * many, pa.string()), pa.array(own[0], pa.binary()).cast(pa.string()), pa.array(own[1][0]), pa.array(own[2][0])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "lang_n"])
            held.clear()

        count = 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                count += batch.num_rows
            if count >= 1 << 16:
                take()
                count = 0
                if sum(len(own[0]) for own in held.values()) > 1 << 20:  # many groups: pass on what is left of them
                    yield from flush()
        if waiting:
            take()
        yield from flush()

    return rows.select("lang", "source", "term", "n", "lang_n").mapInArrow(run, schema)


def common_terms(entries: DataFrame) -> DataFrame:
    """`lang`, `one`, `two`, `value`: what the terms that both sources have add over the terms of either, in partial sums.

    `entries` have (`lang`, `low`, `high`, `e`): of one term the sources (`side`, `source`, `p`, `base`) of two blocks.
    """

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // (p + q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}  # blocks: [row numbers, column numbers, matrix]

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, low, high), (rows, columns, matrix) in sums.items():
                ones, twos = list(rows), list(columns)
                for i, one in enumerate(ones):
                    values = matrix[i, : len(twos)]
                    at = [j for j in np.flatnonzero(values).tolist() if low != high or one.encode() < twos[j].encode()]
                    pairs = [(one, twos[j]) if one.encode() < twos[j].encode() else (twos[j], one) for j in at]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([x for x, _ in pairs], pa.string()), pa.array([x for _, x in pairs], pa.string()), pa.array(values[at].astype(np.int64))], ["lang", "one", "two", "value"])
            sums.clear()

        for batch in batches:
            if len(sums) > 64:  # matrices of a few MB each
                yield from flush()
            for lang, low, high, entries in zip(*(batch.column(c).to_pylist() for c in ("lang", "low", "high", "e"))):
                ours = [e for e in entries if e["side"] == low]
                theirs = ours if low == high else [e for e in entries if e["side"] == high]
                if not ours or not theirs or (low == high and len(ours) < 2):
                    continue
                rows, columns, matrix = sums.setdefault((lang, low, high), [{}, {}, np.zeros((16, 16), np.int64)])
                i = np.array([rows.setdefault(e["source"], len(rows)) for e in ours])
                j = np.array([columns.setdefault(e["source"], len(columns)) for e in theirs])
                if max(len(rows), len(columns)) > len(matrix):
                    grown = np.zeros((2 * max(len(rows), len(columns)),) * 2, np.int64)
                    grown[: len(matrix), : len(matrix)] = matrix
                    matrix = sums[lang, low, high][2] = grown
                p, b = (np.array([e[c] for e in ours], np.int64)[:, None] for c in ("p", "base"))
                q, d = (np.array([e[c] for e in theirs], np.int64) for c in ("p", "base"))
                matrix[np.ix_(i, j)] += f(p, q) - f(p, d) - f(b, q) + f(b, d)
        yield from flush()

    return entries.mapInArrow(run, "lang string, one string, two string, value long")


def audit(spark: SparkSession, docs: DataFrame, least: int = LEAST, ranks: int = RANKS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """`lang`, `source`, `part`, `item`, `value`, `rank`: parts `pair` and `term` of every group."""
    prepare(spark)
    kept = stored(kept_terms(docs, text_col, lang_col, source_col, least))
    blank = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    occurring = docs.select(blank(lang_col, "lang"), blank(source_col, "source")).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("present"), F.sum("heads").alias("heads"))
    groups = stored(occurring.join(own, ["lang", "source"], "left").na.fill(0, ["total", "present", "heads"]))
    langs = groups.groupBy("lang").agg(F.sum("heads").alias("terms"), F.sum("total").alias("lang_total"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # One row for each language: with V, N and how many blocks its sources make.
    groups = spread_join(groups.select("lang", "source", "total", "present"), langs, ["lang"]).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    groups = stored(groups.withColumn("base", F.coalesce(share(F.lit(0).cast("long"), F.col("total"), F.col("terms")), F.lit(0))))
    return pairs(kept, groups).unionByName(terms(kept, groups, ranks))


def terms(kept: DataFrame, groups: DataFrame, ranks: int = RANKS) -> DataFrame:
    """Part `term`: skybands of partitions, merged by group, ranked exactly."""
    near = skyband(skyband(kept, ranks).repartition("lang", "source"), ranks)
    known = near.join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    above = known.withColumns({"p": p, "q": q}).filter("p > q").withColumn("value", divergence(F.col("p"), F.col("q")))
    return ordered(above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")).filter(F.col("rank") <= ranks)


def ordered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))


def pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Part `pair`: each other source of the language, all ranks."""
    info = groups.select("lang", "source", "total", "terms", "block", "blocks", "base")
    shares = stored(spread_join(kept.select("lang", "source", "n"), info.select("lang", "source", "total", "terms", "blocks", "base"), ["lang", "source"]).groupBy("lang", "source", "n", "total", "terms", "blocks", "base").agg(F.count("*").alias("m")))
    # The terms of one source against another's share of nothing, by count; the row of the base carries what neither has.
    against = shares.select("lang", "source", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "m", F.lit(0).cast("long").alias("v"), "blocks")
    nothing = groups.select("lang", "source", F.col("base").alias("p"), (-F.col("present")).alias("m"), F.col("terms").alias("v"), "blocks")
    spread = against.unionByName(nothing).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    packed = groups.groupBy("lang", "block").agg(F.collect_list(F.struct("source", "base")).alias("others"))  # about BLOCK of them
    met = spread_join(stored(spread), packed, ["lang", "block"]).select("lang", "source", "p", "m", "v", F.explode("others").alias("o")).filter("source <> o.source")
    weight = F.col("m") + F.when(F.col("source") < F.col("o.source"), F.col("v")).otherwise(0)
    value = F.when(F.col("p") > 0, weight * divergence(F.col("p"), F.col("o.base"))).otherwise(0)
    either = met.select("lang", F.least("source", "o.source").alias("one"), F.greatest("source", "o.source").alias("two"), value.alias("value"))
    found = either.groupBy("lang", "one", "two").agg(F.sum("value").alias("value")).unionByName(common_terms(entries(kept, info)))
    sums = found.groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item"))))
    return ordered(sums.select("lang", "value", both.alias("b")).select("lang", "b.source", F.lit("pair").alias("part"), "b.item", "value"))


def entries(kept: DataFrame, info: DataFrame) -> DataFrame:
    """Of each term and two blocks of sources, those that have it: each source goes to as many pairs of blocks as there are blocks."""
    known = spread_join(kept.select("lang", "source", "term", "n"), info, ["lang", "source"])
    known = known.withColumn("p", share(F.col("n"), F.col("total"), F.col("terms"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    entry = F.struct(F.col("block").alias("side"), "source", "p", "base")
    return known.groupBy("lang", "term", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).agg(F.collect_list(entry).alias("e")).select("lang", "low", "high", "e")
