"""Text expressions: tokens, hashes and ids, markdown pieces. All stay on the JVM side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The forms of headings and dates.
HEADING = r"^(#{1,6})\s+(.*)$"
DATE = r"^\d{4}-\d{2}-\d{2}$"


def link_targets(text: Column) -> Column:
    """What the wikilinks of a text name, in order: the part between double brackets before an anchor or an alias; links without it are none."""
    inner = F.transform(F.regexp_extract_all(text_or_empty(text), F.lit(r"\[\[([^\]]*)\]\]"), F.lit(1)), lambda x: F.split(x, "[#|]")[0])
    return F.transform(F.filter(inner, lambda x: x != ""), stripped)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def cjk_grams(text: Column) -> Column:
    """Interleaved 2- and 3-grams over all CJK characters of a text, those that are apart included.

    The characters are bound once, as the only element of an array, so that long texts cost linear time.
    """
    none = F.array().cast("array<string>")

    def grams(c: Column) -> Column:
        two = lambda x, i: F.concat(x, F.get(c, i + 1))
        three = lambda x, i: F.array(two(x, i), F.concat(two(x, i), F.get(c, i + 2)))
        return F.flatten(F.transform(c, lambda x, i: F.when(i + 2 < F.size(c), three(x, i)).when(i + 1 < F.size(c), F.array(two(x, i))).otherwise(none)))

    chars = F.split(F.regexp_replace(text, "[^一-鿿]+", ""), "")
    return F.when(text.rlike("[一-鿿]"), F.element_at(F.transform(F.array(chars), grams), 1)).otherwise(none)


def tokens(text: Column) -> Column:
    """CJK grams, then runs of ASCII letters and digits in lower case; other characters separate."""
    text = text_or_empty(text)
    return F.concat(cjk_grams(text), F.transform(F.regexp_extract_all(text, F.lit("[a-zA-Z0-9]+"), F.lit(0)), F.lower))


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(F.regexp_replace(text_or_empty(text), r"^\s+", ""), r"\s+$", "")


def chunk_id(path: Column, header: Column, text: Column) -> Column:
    return F.md5(F.concat_ws("|", path, header, F.substring(text, 1, 100)).cast("binary"))


def content_hash(text: Column) -> Column:
    return F.sha2(text_or_empty(text).cast("binary"), 256)


def doc_text(source: Column, name: Column, text: Column) -> Column:
    """A chunk as the vector channel reads it: its path and file name before the text."""
    return F.concat(F.concat_ws(" ", source, name), F.lit(" | "), text_or_empty(text))


def result_id(query: Column, chunk: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", query, chunk.cast("string")).cast("binary")), 1, 12)


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    name = F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def percent(rate: Column) -> Column:
    return F.format_string("%.1f%%", rate * 100)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once: bound as the only element of an array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pushed(stack: Column, level: Column, title: Column) -> Column:
    """The stack of headings after one more: its first level - 1 entries, then the title."""
    return F.array_append(F.slice(stack, F.lit(1), F.least(level - 1, F.size(stack))), title)
