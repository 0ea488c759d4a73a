"""Notes to chunks: front matter, heading-scoped sections, incremental upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteweave.functions.front_matter import read
from noteweave.functions.text import HEADING, chunk_id, content_hash, once, pushed, stem, stripped

#: Front-matter fields that are kept; others are dropped and absent ones are empty.
FIELDS = ("memory_type", "status", "tags", "source", "owner", "module", "outcome", "task_status", "date_created", "date_updated", "expiry", "confidence")
#: A section's stripped text must be longer than this.
SHORTEST = 20


def front_matter(notes: DataFrame, raw_col: str = "raw") -> DataFrame:
    """All columns with the FIELDS as text, `metadata` (a VARIANT of all fields with their types), `has_front_matter`, `front_matter_error` and `body`.

    Lists are joined by a vertical bar. A missing memory_type is `unknown`, other missing fields are empty. A front matter that
    is empty or no map counts as missing, one that cannot be parsed has an error and no fields.
    """
    rows = notes.withColumn("_read", read(F.col(raw_col)))
    text = {name: F.coalesce(F.try_element_at("_read.fields", F.lit(name)), F.lit("")) for name in FIELDS}
    text["memory_type"] = F.when(text["memory_type"] == "", "unknown").otherwise(text["memory_type"])
    rest = {"metadata": F.try_parse_json("_read.json"), "has_front_matter": F.col("_read.json").isNotNull(), "front_matter_error": F.col("_read.error"), "body": F.col("_read.body")}
    return rows.withColumns(text | rest).drop("_read")


#: Where a heading line begins: the same lines as HEADING has.
BEFORE_HEADING = r"(?md)^(?=#{1,6}[\s&&[^\n]]+[^\n\r\u0085\u2028\u2029]*[\r\u0085\u2028\u2029]?$)"


def _folded(body: Column) -> Column:
    """The sections of a body as an array of (`section`, `header_path`, `text`): one fold over its headings, within the row."""

    def section(part: Column, last: Column) -> Column:
        line = F.substring_index(part, "\n", 1)
        level = F.length(F.regexp_extract(line, HEADING, 1))
        text = F.when(level > 0, F.regexp_replace(part, r"\A[^\n]*\n?", "")).otherwise(part)
        return F.struct(level.alias("level"), F.trim(F.regexp_extract(line, HEADING, 2)).alias("title"), F.when(last, text).otherwise(F.regexp_replace(text, r"\n\z", "")).alias("text"))

    none = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<section:bigint,header_path:string,text:string>>").alias("out"))

    def step(state: Column, part: Column) -> Column:
        n = state["n"] + (part["level"] > 0).cast("long")
        stack = F.when(part["level"] > 0, pushed(state["stack"], part["level"], part["title"])).otherwise(state["stack"])
        found = lambda s: F.struct(n.alias("section"), F.array_join(s, " > ").alias("header_path"), part["text"].alias("text"))
        return once(stack, lambda s: F.struct(s.alias("stack"), n.alias("n"), F.array_append(state["out"], found(s)).alias("out")))

    parts = once(F.split(F.coalesce(body, F.lit("")), BEFORE_HEADING, -1), lambda ps: F.transform(ps, lambda p, i: section(p, i == F.size(ps) - 1)))
    return F.aggregate(parts, none, step, lambda state: state["out"])


def sections(notes: DataFrame, path_col: str = "path", body_col: str = "body") -> DataFrame:
    """`path`, `section` (0: before any heading), `header_path` and `text` of each section of each note.

    The fold over a note's headings runs inside its row, so nothing is shuffled; a heading's place in the stack is positional.
    """
    return notes.select(F.col(path_col).alias("path"), F.explode(_folded(F.col(body_col))).alias("s")).select("path", "s.*")


def chunks(notes: DataFrame, path_col: str = "path", body_col: str = "body") -> DataFrame:
    """Chunks of the sections that are long enough, or of the whole note if none is.

    `id`, `source_file`, `header_path`, `chunk_index`, `text`, `content_hash`; a section without heading is
    named after the file. Nothing is shuffled.
    """
    path, whole = F.col(path_col), stripped(F.col(body_col))
    named = lambda x: F.struct(F.when(x["header_path"] == "", stem(path)).otherwise(x["header_path"]).alias("header_path"), x["text"].alias("text"), F.lit(False).alias("whole"))
    clean = F.transform(_folded(F.col(body_col)), lambda x: F.struct(x["header_path"].alias("header_path"), stripped(x["text"]).alias("text")))
    long = F.transform(F.filter(clean, lambda x: F.length(x["text"]) > SHORTEST), named)
    one = F.filter(F.array(F.struct(stem(path).alias("header_path"), whole.alias("text"), F.lit(True).alias("whole"))), lambda x: F.length(x["text"]) > 0)
    found = notes.select(path.alias("source_file"), F.posexplode(once(long, lambda x: F.when(F.size(x) > 0, x).otherwise(one))).alias("chunk_index", "c"))
    own = F.when(F.col("c.whole"), F.md5(F.concat_ws("|", "source_file", F.lit("full")).cast("binary"))).otherwise(chunk_id(F.col("source_file"), F.col("c.header_path"), F.col("c.text")))
    return found.select("source_file", F.col("c.header_path").alias("header_path"), "chunk_index", F.col("c.text").alias("text"), own.alias("id"), content_hash(F.col("c.text")).alias("content_hash"))


def difference(stored: DataFrame, new: DataFrame, id_col: str = "id", hash_col: str = "content_hash") -> DataFrame:
    """`id` and `action`: insert, update, delete or keep, of each id on either side; of a repeated id the greatest hash counts."""
    a = stored.select(F.col(id_col).alias("id"), F.col(hash_col).alias("old")).groupBy("id").agg(F.max("old").alias("old"))
    b = new.select(F.col(id_col).alias("id"), F.col(hash_col).alias("new")).groupBy("id").agg(F.max("new").alias("new"))
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "update").otherwise("keep")
    return a.join(b, "id", "full_outer").select("id", action.alias("action"))


def upsert(stored: DataFrame, new: DataFrame, id_col: str = "id", hash_col: str = "content_hash") -> DataFrame:
    """The table after the upsert: unchanged rows as stored, changed and new ones from `new`, vanished ones gone.

    Of a repeated id one row counts on either side, that of the greatest hash, as in `difference`.
    """
    rest = [c for c in stored.columns if c != id_col]
    one = lambda rows: rows.groupBy(id_col).agg(F.max_by(F.struct(*rest), hash_col).alias("_r")).select(id_col, "_r.*")
    fresh, old = one(new.select(*stored.columns)), one(stored)
    ids = fresh.select(id_col, hash_col)
    return old.join(ids, [id_col, hash_col], "left_semi").unionByName(fresh.join(old.select(id_col, hash_col), [id_col, hash_col], "left_anti"))
