"""The loop over feedback as one call, with a ledger: trigger, triples, training, candidate, gate, decision; and its online monitor.

Everything that a run decides is one commit: the new state and the run's ledger row stand in one file, so they cannot
disagree, and a run that is repeated under its `run_id` after a commit gives that commit's row again. A crash before the commit
leaves at most a candidate collection that nothing names; the repeated run writes it anew. Candidates have versions of their
own, one more than any in the ledger.

What a collection is read by is named by the state (`active_collection`, `ab.candidate_collection`): promoting swaps names, no rows.
The model here is the pair of channel weights of hybrid search, fitted on triples; `train` and `measure` take any other.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.operators import evaluate, feedback, ranking
from noteweave.sources import commits
from noteweave.sources.notes import write_collection
from noteweave.sources.state import RATIO
from noteweave.sources.tables import staged

#: Triples below which those of the cases are added; weights that training tries.
FEW, WEIGHTS = 30, ((1.0, 1.0), (2.0, 1.0), (1.0, 2.0), (4.0, 1.0), (1.0, 4.0))
NO_AB = {"enabled": False, "candidate_collection": None, "candidate_model": None, "traffic_ratio": 0.0, "started_at": None, "baseline_metrics": None}
FIRST = {"version": 0, "active_collection": "notes", "active_model": "1.0,1.0", "ab": NO_AB, "updated_at": None}


def state(spark: SparkSession, root: str) -> dict:
    """The state after the last commit, or the first one."""
    last = commits.newest(spark, f"{root}/commits")
    return last["state"] if last else FIRST


def ledger(spark: SparkSession, root: str) -> list[dict]:
    """The rows of all runs, in order."""
    return [commits.read(spark, f"{root}/commits", n)["record"] for n in commits.numbers(spark, f"{root}/commits")]


def _seen(spark: SparkSession, root: str, run_id: str | None) -> dict | None:
    return next((r for r in ledger(spark, root) if run_id is not None and r["run_id"] == run_id), None)


def _log(spark: SparkSession, root: str, now: str, run_id: str | None, record: dict, new: dict | None = None) -> dict:
    """Commit a ledger row, with a changed state if there is one; that is stamped."""
    known = commits.numbers(spark, f"{root}/commits")
    after = state(spark, root) if new is None else new | {"updated_at": now}
    record = {"run_id": run_id or uuid.uuid4().hex, "timestamp": now} | record
    commits.commit(spark, f"{root}/commits", (known[-1] if known else 0) + 1, {"state": after, "record": record})
    return record


def as_docs(chunked: DataFrame) -> DataFrame:
    """Chunks as search reads them: their path and heading before the text."""
    return chunked.select(F.col("id").alias("doc_id"), F.concat_ws(" ", "source_file", "header_path", "text").alias("text"), "source_file", "header_path", F.col("text").alias("chunk"))


def numbered(cases: DataFrame) -> DataFrame:
    """Cases with a `query_id` that is the query's own hash."""
    return cases.withColumn("query_id", F.xxhash64("query"))


def _weights(model: str) -> tuple[float, float]:
    vector, keyword = map(float, model.split(","))
    return vector, keyword


def train(chunked: DataFrame, triples: DataFrame, base: str) -> str:
    """The channel weights under which the positives of the triples come first most often (mean reciprocal rank), the base's on ties."""
    queries = numbered(triples.select("query").distinct())
    vector, keyword = ranking.channels(as_docs(chunked), queries)
    wanted = queries.join(triples.select("query", "pos").distinct(), "query").join(chunked.select(F.col("id").alias("doc_id"), F.col("text").alias("pos")), "pos")
    tried = list(dict.fromkeys([_weights(base), *WEIGHTS]))
    best = (-1.0, base)
    for pair in tried:
        found = ranking.hits(ranking.fuse(vector, keyword, *pair), ranking.POOL)
        score = found.join(wanted.select("query_id", "doc_id"), ["query_id", "doc_id"]).groupBy("query_id").agg((1 / F.min("rank")).alias("r")).agg(F.round(F.coalesce(F.sum("r"), F.lit(0.0)), 6)).first()[0]
        best = max(best, (score, ",".join(map(str, pair))), key=lambda x: x[0])
    return best[1]


def search_cases(chunked: DataFrame, cases: DataFrame, model: str, k: int = 20) -> DataFrame:
    """`query`, `gold`, `rank`, `source_file`, `text` of the first k chunks of each case's query."""
    asked = numbered(cases)
    vector, keyword = ranking.channels(as_docs(chunked), asked.select("query_id", "query").distinct())
    found = ranking.hits(ranking.fuse(vector, keyword, *_weights(model)), k)
    shown = chunked.select(F.col("id").alias("doc_id"), "source_file", "text")
    return asked.join(found.select("query_id", "rank", "doc_id"), "query_id").join(shown, "doc_id").select("query", "gold", "rank", "source_file", "text")


def measure(chunked: DataFrame, cases: DataFrame, model: str) -> dict:
    """Hit@1, Hit@5 and MRR of the cases: the first chunk whose file holds the gold."""
    found = search_cases(chunked, cases, model).filter(F.col("source_file").contains(F.col("gold")))
    first = cases.select("query", "gold").distinct().join(found.groupBy("query", "gold").agg(F.min("rank").alias("first")), ["query", "gold"], "left")
    return evaluate.metrics(first).first().asDict()


def build_candidate(spark: SparkSession, root: str, name: str, chunked: DataFrame, model: str) -> dict:
    """Write the candidate's collection anew under its own name, and beside it what it is (`role`, `model`, `count`)."""
    write_collection(chunked, f"{root}/collections", name)
    count = spark.read.parquet(f"{root}/collections").filter(F.col("collection") == name).count()
    info = spark.createDataFrame([(name, "candidate", model, count)], "name string, role string, model string, count long")
    info.coalesce(1).write.mode("overwrite").json(f"{root}/collection_info/{name}")
    return {"built": count > 0, "count": count, "reason": "" if count else "no chunks"}


def run(
    spark: SparkSession, root: str, rows: DataFrame, chunked: DataFrame, cases: DataFrame, now: str, apply: bool = False, force: bool = False, least: int = feedback.TRIGGER,
    run_id: str | None = None, train: Callable = train, measure: Callable = measure, build: Callable = build_candidate,
) -> dict:
    """One turn of the loop; returns its ledger row. Without `apply` the state stays as it is.

    `rows` is the feedback (`query`, `source_file`, `header_path`, `adopted`, `timestamp`), every row of which counts for the trigger.
    """
    seen = _seen(spark, root, run_id)
    if seen:
        return seen
    log = lambda record, new=None: _log(spark, root, now, run_id, record, new)
    old = state(spark, root)
    positive = rows.filter("adopted").count()
    if not force and positive < least:
        return log({"event": "skip_insufficient_feedback", "action": "skip", "positive": positive, "threshold": least})
    triples, source = staged(feedback.text_triples(rows, chunked)), "feedback"
    n = triples.count()
    if n < FEW:
        boot = staged(feedback.case_triples(cases, chunked, search_cases(chunked, cases, old["active_model"]).drop("gold")))
        triples, source = (triples.unionByName(boot), "feedback+bootstrap") if n else (boot, "bootstrap")
        n = triples.count()
    if not n:
        return log({"event": "closed_loop_run", "action": "skip_no_triples", "n_triples": 0})
    version = 1 + max([old["version"], *(r.get("version") or 0 for r in ledger(spark, root))])
    model, name = train(chunked, triples, old["active_model"]), f"{old['active_collection'].split('_ft_v')[0]}_ft_v{version}"
    info = build(spark, root, name, chunked, model)
    if not info["built"]:
        return log({"event": "candidate_build_failed", "action": "rollback_build_failed", "version": version, "reason": info["reason"]})
    base, mine = measure(chunked, cases, old["active_model"]), measure(chunked, cases, model)
    judged = spark.createDataFrame([(mine["hit5"], mine["mrr"], base["mrr"])], "hit5 double, mrr double, base_mrr double")
    verdict = feedback.gate(judged).first().passed
    new = None
    if verdict and apply:
        new = old | {"ab": {"enabled": True, "candidate_collection": name, "candidate_model": model, "traffic_ratio": RATIO, "started_at": now, "baseline_metrics": base}}
    elif not verdict and apply and old["ab"]["enabled"]:
        new = old | {"ab": old["ab"] | {"enabled": False}}
    return log({
        "event": "closed_loop_run", "version": version, "action": "promote_to_ab" if verdict else "rollback_offline", "n_triples": n, "triple_source": source, "candidate_collection": name,
        "gate_verdict": verdict, "gate_deltas": {m: round(mine[m] - base[m], 4) for m in ("hit1", "hit5", "mrr")}, "applied": apply,
    }, new)


def monitor(spark: SparkSession, root: str, rows: DataFrame, now: str, apply: bool = False, run_id: str | None = None) -> dict:
    """Decide the online test from the feedback since it began (`model_version`, `timestamp`, `adopted`); every row counts.

    A promotion makes the candidate the active collection under the next version; a rollback forgets it; both end the test.
    """
    seen = _seen(spark, root, run_id)
    if seen:
        return seen
    old = state(spark, root)
    ab = old["ab"]
    if not ab["enabled"] or not ab["candidate_collection"]:
        return {"action": "no_ab"}
    arm = F.col("model_version") == ab["candidate_collection"]
    since = rows.filter(F.col("model_version").isin(old["active_collection"], ab["candidate_collection"]) & (F.col("timestamp") >= (ab["started_at"] or "")))
    arms = feedback.adoption(since.withColumn("_all", F.lit(1)), arm, ["_all"], F.col("adopted"))
    found = feedback.decide(spark.range(1).select(F.lit(1).alias("_all")).join(arms, "_all", "left").na.fill(0)).first()
    action = {"keep": "keep_ab", "promote": "promote_full", "rollback": "rollback_online"}[found.action]
    new = None
    if apply and action == "rollback_online":
        new = old | {"ab": ab | {"enabled": False, "candidate_collection": None, "candidate_model": None}}
    elif apply and action == "promote_full":
        new = old | {"active_collection": ab["candidate_collection"], "active_model": ab["candidate_model"], "version": old["version"] + 1, "ab": NO_AB}
    rates = {"n_baseline": found.n_base, "n_candidate": found.n_cand, "rate_baseline": round(found.rate_base, 4), "rate_candidate": round(found.rate_cand, 4)}
    return _log(spark, root, now, run_id, {"event": "ab_monitor", "action": action, "applied": apply} | rates, new)


def serving(spark: SparkSession, root: str, requests: DataFrame, key: str) -> DataFrame:
    """`requests` with the `collection` that serves each: the candidate's for its share of the traffic while a test runs."""
    now = state(spark, root)
    ab = now["ab"]
    if not ab["enabled"] or not ab["candidate_collection"]:
        return requests.withColumn("collection", F.lit(now["active_collection"]))
    routed = feedback.route(requests, key, ab["traffic_ratio"])
    return routed.withColumn("collection", F.when(F.col("variant") == "candidate", ab["candidate_collection"]).otherwise(now["active_collection"])).drop("bucket", "variant")
