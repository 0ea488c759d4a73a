"""Data-quality rules. Each is one predicate query giving (dimension, code, file, detail) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteweave.functions.text import DATE, link_targets, stem, stripped
from noteweave.operators.ingest import front_matter
from noteweave.sources.notes import UNSEEN, exists, read_names, read_notes

#: The enumerations, required fields and ages of the note format.
MEMORY_TYPES = ("fact", "preference", "experience", "task_state", "navigation", "safety")
STATUSES = ("active", "in_progress", "archived", "deprecated", "draft", "completed", "approved")
STALE_DAYS = {"fact": 180, "preference": 180, "experience": 365, "task_state": 30, "navigation": 180}
STALE_DEFAULT, SHORT_BODY = 180, 50
REQUIRED = {
    "fact": ("memory_type", "source", "date_updated"),
    "preference": ("memory_type", "owner", "date_updated"),
    "experience": ("memory_type", "date_updated"),
    "task_state": ("memory_type", "status", "date_updated"),
    "navigation": ("memory_type", "date_updated"),
}
TEMPLATES = "模板"
TITLES = {"A": "Front matter", "B": "Expired and stale", "C": "Broken links", "D": "Contents", "E": "Index"}


def issue(rows: DataFrame, dimension: str, code: str, file: str, detail: Column) -> DataFrame:
    return rows.select(F.lit(dimension).alias("dimension"), F.lit(code).alias("code"), F.col(file).cast("string").alias("file"), detail.cast("string").alias("detail"))


def required_fields(rows: DataFrame, rules: dict[str, tuple[str, ...]], type_col: str, file: str, default: tuple[str, ...] = ()) -> DataFrame:
    """A row for each field that its type requires and that is null or blank."""
    required = F.create_map(*(x for t, fields in rules.items() for x in (F.lit(t), F.array(*map(F.lit, fields)))))
    needed = F.coalesce(F.try_element_at(required, F.col(type_col)), F.array(*map(F.lit, default)).cast("array<string>"))
    names = sorted({f for fields in (*rules.values(), default) for f in fields})
    blank = F.array(*(F.when(F.trim(F.coalesce(F.col(n).cast("string"), F.lit(""))) == "", F.lit(n)) for n in names))
    return issue(rows.withColumn("_f", F.explode(F.array_intersect(needed, blank))), "A", "missing_field", file, F.col("_f"))


def not_in(rows: DataFrame, value: str, allowed: tuple[str, ...], file: str, code: str) -> DataFrame:
    found = F.coalesce(F.col(value), F.lit(""))
    return issue(rows.filter((found != "") & ~found.isin(*allowed)), "A", code, file, found)


def bad_dates(rows: DataFrame, fields: tuple[str, ...], file: str) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("name"), F.col(f).cast("string").alias("value")) for f in fields)))
    bad = rows.withColumn("_d", each).filter((F.coalesce("_d.value", F.lit("")) != "") & ~F.col("_d.value").rlike(DATE))
    return issue(bad, "A", "bad_date", file, F.concat_ws("=", "_d.name", "_d.value"))


def bad_confidence(rows: DataFrame, value: str, file: str) -> DataFrame:
    text = F.coalesce(F.col(value).cast("string"), F.lit(""))
    number = text.try_cast("double")
    code = F.when(number.isNull(), "not_numeric").when(~number.between(0.0, 1.0), "out_of_range")
    bad = rows.withColumn("_c", code).filter((F.trim(text) != "") & F.col("_c").isNotNull())
    return bad.select(F.lit("A").alias("dimension"), F.col("_c").alias("code"), F.col(file).cast("string").alias("file"), text.alias("detail"))


def dated(value: str) -> Column:
    """The text of a field where it has the form of a date, else null."""
    text = F.col(value).cast("string")
    return F.when(text.rlike(DATE), text)


def expiry_before_update(rows: DataFrame, expiry: str, updated: str, file: str) -> DataFrame:
    return issue(rows.filter(dated(expiry) < dated(updated)), "A", "expiry_before_update", file, F.col(expiry))


def expired(rows: DataFrame, expiry: str, file: str, as_of: str) -> DataFrame:
    day = dated(expiry).try_cast("date")
    return issue(rows.filter(day < F.lit(as_of).cast("date")), "B", "expired", file, day)


def stale(rows: DataFrame, type_col: str, updated: str, file: str, as_of: str, days: dict[str, int] | None = None, default: int = STALE_DEFAULT) -> DataFrame:
    days = STALE_DAYS if days is None else days
    limit = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in days.items() for x in pair)), F.col(type_col)), F.lit(default))
    age = F.datediff(F.lit(as_of).cast("date"), dated(updated).try_cast("date"))
    return issue(rows.filter(age > limit), "B", "stale", file, age)


def links(notes: DataFrame, file: str, body: str) -> DataFrame:
    """`file`, `target` of each wikilink, anchors and aliases cut off."""
    return notes.select(F.col(file).alias("file"), F.explode(link_targets(F.col(body))).alias("target"))


def broken(found: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """The links whose target is no known path, nor the end of one after a slash; empty targets resolve.

    Every known path is exploded into its ends, so the test is an equality join and not a comparison of all.
    """
    parts = F.split(F.regexp_replace(F.col(name), r"\\", "/"), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    every = known.select(F.explode(F.array_append(ends, F.col(name))).alias("_t")).distinct()
    return found.filter("target <> ''").withColumn("_t", F.regexp_replace("target", r"\\", "/")).join(every, "_t", "left_anti").select("file", "target")


def broken_summary(broken_links: DataFrame) -> DataFrame:
    """For each missing target: references, sources, the first three of them, and whether there are more."""
    sources = broken_links.groupBy("target", "file").agg(F.count("*").alias("n"))
    return sources.groupBy("target").agg(F.sum("n").alias("refs"), F.count("*").alias("n_sources"), F.min("file").alias("first_source")).select("target", "refs", "n_sources", "first_source", (F.col("n_sources") > 3).alias("more"))


def short_bodies(rows: DataFrame, body: str, file: str) -> DataFrame:
    size = F.length(stripped(F.col(body)))
    return issue(rows.filter(size < SHORT_BODY), "D", "short_body", file, size)


def duplicate_names(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def index_consistency(indexed: DataFrame, on_disk: DataFrame, key: str) -> DataFrame:
    """`key` and `code`: indexed but gone, or on disk but not indexed."""
    a, b = indexed.select(key).distinct(), on_disk.select(key).distinct()
    gone = a.join(b, key, "left_anti").select(key, F.lit("indexed_not_on_disk").alias("code"))
    return gone.unionByName(b.join(a, key, "left_anti").select(key, F.lit("on_disk_not_indexed").alias("code")))


def counts(issues: DataFrame) -> DataFrame:
    """Issues for each dimension and code, and totals for each dimension and over all (`all`)."""
    rolled = issues.rollup("dimension", "code").agg(F.count("*").alias("n"))
    return rolled.select(F.coalesce("dimension", F.lit("all")).alias("dimension"), F.coalesce("code", F.lit("all")).alias("code"), "n")


def is_template(path: Column) -> Column:
    """Whether a note lies in a template folder, where placeholders stand for fields."""
    return F.array_contains(F.split(path, "/"), TEMPLATES)


def parsed(notes: DataFrame) -> DataFrame:
    """The notes whose front matter could be read or is missing; all of them where `front_matter_error` is no column."""
    return notes.filter(F.col("front_matter_error").isNull()) if "front_matter_error" in notes.columns else notes


def structure(notes: DataFrame, path: str = "path") -> DataFrame:
    """Front-matter issues of notes as `ingest.front_matter` reads them.

    A note whose front matter is unparsable, missing or empty has that one issue; a template is only tested for a type that does
    not exist; all others also for a missing type, and for each field that their type requires (any other type: the type itself).
    """
    typed = parsed(notes).withColumn("memory_type", F.when(F.col("memory_type") != "unknown", F.col("memory_type")).otherwise(""))
    held = typed.filter("has_front_matter")
    own = held.filter(~is_template(F.col(path)))
    found = issue(typed.filter("not has_front_matter"), "A", "no_front_matter", path, F.lit(""))
    if "front_matter_error" in notes.columns:
        found = found.unionByName(issue(notes.filter(F.col("front_matter_error").isNotNull()), "A", "bad_front_matter", path, F.col("front_matter_error")))
    return (
        found.unionByName(issue(own.filter("memory_type = ''"), "A", "missing_type", path, F.lit("")))
        .unionByName(not_in(held, "memory_type", MEMORY_TYPES, path, "bad_type"))
        .unionByName(required_fields(own, REQUIRED, "memory_type", path, ("memory_type",)))
    )


def repeated_stems(notes: DataFrame, path: str = "path") -> DataFrame:
    """Issues of folders that hold several notes of one name: the folder, and those names in order."""
    folder = F.regexp_replace(path, "/?[^/]*$", "")
    twice = duplicate_names(notes.select(F.when(folder == "", ".").otherwise(folder).alias("folder"), stem(F.col(path)).alias("name")), ("folder", "name"))
    names = twice.groupBy("folder").agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("names"))
    return issue(names, "D", "duplicate_name", "folder", F.col("names"))


def run(notes: DataFrame, as_of: str, indexed: DataFrame | None = None, files: DataFrame | None = None, path: str = "path") -> DataFrame:
    """All issues of a vault: `notes` with front matter and `body`, other `files` (`name`) that links may name, `indexed` paths.

    Fields are tested on notes with front matter that are no templates; expiry, age, links, bodies and names on all that are parsed.
    """
    read = parsed(notes)
    held = read.filter(F.col("has_front_matter") & ~is_template(F.col(path)))
    dates = ("date_created", "date_updated", "expiry")
    found = structure(notes, path).unionByName(not_in(held, "status", STATUSES, path, "bad_status")).unionByName(bad_dates(held, dates, path)).unionByName(bad_confidence(held, "confidence", path))
    found = found.unionByName(expiry_before_update(held, "expiry", "date_updated", path)).unionByName(expired(read, "expiry", path, as_of)).unionByName(stale(read, "memory_type", "date_updated", path, as_of))
    known = notes.select(F.regexp_replace(path, r"\.md$", "").alias("name")).unionByName(notes.select(F.col(path).alias("name")))
    known = (known if files is None else known.unionByName(files.select("name"))).distinct()
    missing = broken(links(read, path, "body"), known)
    found = found.unionByName(issue(missing, "C", "broken_link", "file", F.col("target")))
    found = found.unionByName(short_bodies(read, "body", path)).unionByName(repeated_stems(read, path))
    if indexed is not None:
        gone = index_consistency(indexed.select(path), indexable(read, path), path)
        found = found.unionByName(issue(gone, "E", "index", path, F.col("code")))
    return found


def vault(spark: SparkSession, folder: str, as_of: str, indexed: DataFrame | None = None) -> DataFrame:
    """All issues of a folder of notes; of a folder that does not exist, that one."""
    if not exists(spark, folder):
        return spark.createDataFrame([("A", "no_vault", folder, "")], "dimension string, code string, file string, detail string")
    notes = front_matter(read_notes(spark, folder, UNSEEN))
    return run(notes, as_of, indexed, read_names(spark, folder, UNSEEN[:1]))


def indexable(notes: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """The notes that an index should hold: no templates, and no bodies too short for a chunk."""
    return notes.filter(~is_template(F.col(path)) & (F.length(stripped(F.col(body))) >= SHORT_BODY))


def coverage(notes: DataFrame, path: str = "path") -> DataFrame:
    """`files`, `with_front_matter` and `links` of a vault."""
    read = parsed(notes).agg(F.count_if(F.col("has_front_matter")).alias("with_front_matter"), F.coalesce(F.sum(F.size(link_targets(F.col("body")))), F.lit(0)).cast("long").alias("links"))
    return notes.agg(F.count("*").alias("files")).crossJoin(read)  # one row each


def report_text(issues: DataFrame, limit: int = 30) -> DataFrame:
    """The report as lines (`at`, `line`): for each dimension its title with the number of issues, and the first `limit` of them."""
    shown = report(issues, limit)
    total = issues.groupBy("dimension").agg(F.count("*").alias("n"))
    titles = issues.sparkSession.createDataFrame(list(TITLES.items()), "dimension string, title string").join(total, "dimension", "left")
    head = titles.select("dimension", F.lit(0).alias("turn"), F.concat(F.lit("## "), "dimension", F.lit(". "), "title", F.lit(" ("), F.coalesce("n", F.lit(0)), F.lit(")")).alias("line"))
    body = shown.select("dimension", "turn", F.concat(F.lit("- "), "file", F.lit(": "), "code", F.when(F.col("detail") != "", F.concat(F.lit(" "), F.col("detail"))).otherwise("")).alias("line"))
    rest = shown.filter("more > 0").select("dimension", F.lit(limit + 1).alias("turn"), F.concat(F.lit("- and "), "more", F.lit(" more")).alias("line")).distinct()
    lines = head.unionByName(body).unionByName(rest)
    return lines.select(F.struct("dimension", "turn").alias("at"), "line").orderBy("at")


def report(issues: DataFrame, limit: int = 30) -> DataFrame:
    """The first `limit` issues of each dimension by file, code and detail, with how many more there are.

    The limit is the feature of a report.
    """
    turn = F.row_number().over(Window.partitionBy("dimension").orderBy("file", "code", "detail"))
    total = issues.groupBy("dimension").agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("more"))
    return issues.withColumn("turn", turn).filter(F.col("turn") <= limit).join(F.broadcast(total), "dimension")


def broken_sources(broken_links: DataFrame) -> DataFrame:
    """The missing targets, most references first: `target`, `refs`, the first three sources, and whether there are more.

    Sources are counted by (target, source) first; their first three go by partial aggregation on salted targets, so a popular target
    is never sorted in one task.
    """
    each = broken_links.groupBy("target", "file").agg(F.count("*").alias("n"))
    first = lambda files: F.slice(F.sort_array(files), 1, 3)
    part = each.groupBy("target", F.pmod(F.xxhash64("file"), F.lit(64)).alias("part")).agg(F.sum("n").alias("refs"), F.count("*").alias("many"), F.collect_list("file").alias("files"))
    few = part.select("target", "refs", "many", first(F.col("files")).alias("files"))
    whole = few.groupBy("target").agg(F.sum("refs").alias("refs"), first(F.flatten(F.collect_list("files"))).alias("files"), F.sum("many").alias("many"))
    return whole.select("target", "refs", F.array_join(F.transform("files", lambda x: x.cast("string")), ", ").alias("sources"), (F.col("many") > 3).alias("more")).orderBy(F.desc("refs"), "target")
