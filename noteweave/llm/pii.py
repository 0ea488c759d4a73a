"""Personal data: detected entities get keyed, type-consistent surrogates. DataFrame functions only.

Detection is one pattern, for e-mail addresses, IP addresses, card and account
numbers, social security numbers, phone numbers, IBANs, secrets (hexadecimal digests and access keys) and names
(after a form of address or words like "my name is", or a listed given name with a surname). Only texts with mentions are
read by it a second time, to be cut at them. A name that was found once in a text is replaced in all of it: each of its words, wherever it
stands alone or without its form of address.

A surrogate is computed once for each different entity, from its canonical form, an attempt number and a key
(HMAC-SHA-256): digits become digits, letters letters of the same script and case, separators stay, so the format
survives; card numbers and IBANs keep their check digits' validity; e-mail addresses keep their top-level domain, and equal
domains stay equal; given names become names of the same gender and script, and surnames are built from syllables of
the script. Mentions that differ in format only, such as a phone number with and without brackets, share a canonical
form, so coreference holds within and across rows.

Distinctness is checked: a surrogate that a different entity also got, or that is itself a real entity of
the table, is drawn anew with the next attempt number. Only entities that clash are drawn again, and those that
still clash after ROUNDS draws (their form leaves no room) get a keyed token with their type, so it always ends.

Entities are a small table beside the texts; it is dealt by entity and never gathered. Each different mention is
rendered once. Rows without entities are not shuffled; the others are joined once with the rendered mentions of their
own text. Mentions, entities and texts that hold more than a small share of the rows are split over many tasks.

Defined results: null and empty texts stay as they are, with no entities; the count of entities is that of the mentions the pattern finds; repeated rows and equal
texts get equal results; ties (two entities with one surrogate) go to the smaller hash; an empty table gives an empty
result; all columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteweave.llm.common import checkpoint, named, positional, spread_join, stored

#: Given names by script and gender (fixed values).
GIVEN = {
    "latin_f": "Anna Maria Emma Julia Laura Sarah Sophie Clara Helen Alice Marie Claire Camille Louise Jeanne Carmen Lucia Elena Paula Isabel Ingrid Greta Katrin Heike Petra Mary Jane Linda Susan Karen".split(),
    "latin_m": "John James Robert Michael William David Richard Thomas Peter Paul Pierre Jean Luc Henri Louis Juan Carlos Diego Miguel Pablo Hans Klaus Jürgen Stefan Otto George Edward Daniel Martin Simon".split(),
    "cyrillic_f": "Анна Мария Елена Ольга Ирина Наталья Светлана Татьяна Екатерина Юлия".split(),
    "cyrillic_m": "Иван Сергей Алексей Дмитрий Николай Михаил Андрей Владимир Павел Борис".split(),
    "greek_f": "Μαρία Ελένη Κατερίνα Σοφία Αγγελική".split(),
    "greek_m": "Γιώργος Νίκος Δημήτρης Κώστας Παύλος".split(),
}
#: Forms of address before a name.
ADDRESS = "Mr Mrs Ms Miss Dr Prof Herr Frau Señor Señora Sr Sra Monsieur Madame Mme Mlle Г-н Г-жа".split()
#: Syllables of made-up surnames (fixed values).
SYLLABLES = {
    "latin": ("Bar Cal Dor Fen Gar Hol Kel Lan Mar Nor Per Ros Sel Tor Val Wen".split(), "a e i o u er en an in on ar el or il us im".split(), "berg dale field ford land ley mann ner sen son stein ton vale wick wood worth".split()),
    "cyrillic": ("Бар Вол Гор Дан Кол Лав Мор Ник Пав Рад Сав Тар".split(), "а о и е ал ен ит ар".split(), "енк ич ов ин ск ев".split()),
    "greek": ("Παπ Αντ Δημ Γεω Νικ Κων Μαρ Σταυ".split(), "α ο ι ε αρ ιν".split(), "ίδης όπουλος άκης ίου άτος ούδης".split()),
}

#: Endings of made-up given names, by script and gender (fixed values).
ENDINGS = {
    "latin_f": "a ia ina ella ette ine".split(),
    "latin_m": "o us ard bert win mund".split(),
    "cyrillic_f": "а ия ина ела".split(),
    "cyrillic_m": "ий ан слав мир".split(),
    "greek_f": "α ία ίνα ούλα".split(),
    "greek_m": "ος ης ιος ων".split(),
}
#: Draws before an entity gets a token; the first NATURAL ones take a listed given name.
ROUNDS, NATURAL = 12, 2

_FIRST = "|".join(n for names in GIVEN.values() for n in names)
_PART = r"\p{Lu}[\p{L}'’-]++"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:(?:{'|'.join(ADDRESS)})\.? {_PART}(?: {_PART}){{0,3}}|(?:{_FIRST})(?: {_PART}){{1,3}}|(?<=[Nn]ame is |[Nn]ame: |[Nn]amed ){_PART}(?: {_PART}){{1,3}})"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)*+(?<=\.\p{L}{2,24})"
SECRET = r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|(?:AKIA|ASIA)[0-9A-Z]{16}|(?:ghp_|gho_|sk-|xox[bp]-)[0-9A-Za-z-]{16,128})(?![\p{L}\p{N}])"
IP = r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\p{L}\p{N}]|\.\d)"
IP6 = r"(?<![\p{L}\p{N}:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\p{L}\p{N}:])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
CARD = r"(?<![\p{L}\p{N}+.-])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\p{L}\p{N}])"
SSN = r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])"
PHONE = r"(?<![\p{L}\p{N}+.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,5}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4}|0\d{2,4}[ /-]\d{5,8}|0\d(?:[ .-]\d{2}){4}|0\d{2,4} \d{3,4} \d{3,4}|[67]\d{2} \d{3} \d{3}(?! \d{3}(?!\d)))(?![\p{L}\p{N}])"
#: In this order; the first that matches names the type.
TYPES = {"email": EMAIL, "secret": SECRET, "ip": IP, "ip6": IP6, "iban": IBAN, "ssn": SSN, "card": CARD, "phone": PHONE, "name": NAME}
PATTERN = "|".join(TYPES.values())
#: Texts with neither two digits nor an at sign, an access key's start, a colon between hexadecimal digits, a point
#: between digits or 32 of the letters of hexadecimal numbers, nor this, cannot match. The capital is tested first, so that most characters cost one comparison.
NAMED = rf"(?=[A-ZÀ-ÞΑ-ΩА-Я])(?<![\p{{L}}\p{{N}}])(?:(?:{'|'.join(ADDRESS)})\.?|{_FIRST}) \p{{Lu}}"

STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "xoxb-", "xoxp-")
DIGITS = ("card", "ssn", "phone")


#: Words before a name, tested without a pattern.
CUES = ("ame is ", "ame: ", "amed ")


def mentions(text: Column) -> Column:
    """The mentions in a text, in order, repeats included."""
    none = F.array().cast("array<string>")
    may = text.contains("@") | reduce(lambda a, b: a | b, map(text.contains, (*STARTS, *CUES))) | text.rlike("[0-9]{2}") | text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]") | text.contains("::") | text.rlike(r"[0-9]\.[0-9]") | text.rlike("[0-9a-f]{32}|[0-9A-F]{32}") | text.rlike(NAMED)
    return F.when(may, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(none)


def kind(mention: Column) -> Column:
    """The type of a mention, told from its form."""
    shapes = {
        "email": mention.contains("@"),
        "secret": mention.rlike(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?:AKIA|ASIA)[0-9A-Z]{16}|(?:ghp_|gho_|sk-|xox[bp]-).*)$"),
        "ip": mention.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"),
        "ip6": mention.rlike(r"^[0-9A-Fa-f:]+$") & mention.contains(":"),
        "iban": mention.rlike(r"^[A-Z]{2}\d{2}"),
        "ssn": mention.rlike(r"^\d{3}-\d{2}-\d{4}$"),
        "card": mention.rlike(r"^(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})$"),
        "name": mention.rlike(r"^\p{Lu}"),
    }
    chosen = None
    for name, test in shapes.items():
        chosen = F.when(test, name) if chosen is None else chosen.when(test, name)
    return chosen.otherwise("phone")


def _lists(names: dict[str, list[str]]) -> Column:
    return F.create_map(*(F.lit(x) for group, values in names.items() for v in values for x in (v, group)))


def _upper(word: Column) -> Column:
    return (F.length(word) > 1) & (F.upper(word) == word)


def token_key(token: Column) -> Column:
    """The entity key of one word of a name; null for a form of address."""
    plain = F.when(_upper(token), F.initcap(token)).otherwise(token)
    group = F.try_element_at(_lists(GIVEN), plain)
    return F.when(token.rlike(rf"^(?:{'|'.join(ADDRESS)})\.?$"), F.lit(None)).otherwise(F.concat_ws("|", F.coalesce(F.concat(F.lit("given_"), group), F.lit("surname")), plain))


def keys(mention: Column) -> Column:
    """The entity keys `type|canonical form` in a mention: one, or one for each word of a name."""
    what = kind(mention)
    canonical = F.when(what.isin(*DIGITS), F.regexp_replace(mention, "[^0-9]", "")).when(what == "email", F.lower(mention)).when(what == "iban", F.regexp_replace(mention, " ", "")).otherwise(mention)
    names = F.filter(F.transform(F.split(mention, " "), token_key), lambda k: k.isNotNull())
    return F.when(what == "name", names).otherwise(F.array(F.concat_ws("|", what, canonical)))


def letters(first: int, last: int, category: str = "L") -> str:
    """The letters of a range of code points whose Unicode category starts with `category`."""
    return "".join(chr(i) for i in range(first, last + 1) if unicodedata.category(chr(i)).startswith(category))


#: ASCII; then by case Latin-1, Cyrillic, Greek, Armenian; then Georgian, Hebrew, Arabic, Devanagari, Thai, kana.
ALPHABETS = (
    "0123456789", letters(0x61, 0x7A), letters(0x41, 0x5A), letters(0xDF, 0xFF, "Ll"), letters(0xC0, 0xDE, "Lu"), letters(0x430, 0x45F, "Ll"), letters(0x400, 0x42F, "Lu"),
    letters(0x3AC, 0x3CE, "Ll"), letters(0x386, 0x3A9, "Lu"), letters(0x561, 0x586, "Ll"), letters(0x531, 0x556, "Lu"), letters(0x10D0, 0x10F0), letters(0x5D0, 0x5EA), letters(0x620, 0x64A, "Lo"),
    letters(0x905, 0x939), letters(0xE01, 0xE2E), letters(0x3041, 0x3096), letters(0x30A1, 0x30FA),
)
HAN, HANGUL = letters(0x4E00, 0x4EFF), letters(0xAC00, 0xACFF)
_HEX = "0123456789abcdef"


def keyed(secret: str, message: Column) -> Column:
    """HMAC-SHA-256 of a message, in hexadecimal."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytearray(b ^ 0x36 for b in key)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytearray(b ^ 0x5C for b in key)), F.unhex(inner)), 256)


def _stream(secret: str, seed: Column, length: Column) -> Column:
    """Keyed hexadecimal digits, two for each of `length` characters."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(length / 32).cast("int")), lambda b: keyed(secret, F.concat_ws("|", seed, b.cast("string")))), "")


def _drawn(stream: Column, at: Column, n: Column) -> Column:
    return F.pmod(F.conv(F.substring(stream, at * 2 + 1, F.lit(2)), 16, 10).cast("int"), n)


def _chars(value: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1))), lambda i: F.substring(value, i, F.lit(1)))


def _masked(value: Column, secret: str, seed: Column, hexadecimal: bool = False) -> Column:
    """`value` with each letter and digit drawn anew from its own alphabet; letters of scripts that are not listed become Latin ones."""
    stream = _stream(secret, seed, F.length(value))
    listed = F.array(*map(F.lit, ALPHABETS))

    def one(c: Column, i: Column) -> Column:
        if hexadecimal:
            own = F.when(c.rlike("[0-9a-f]"), _HEX).when(c.rlike("[A-F]"), "ABCDEF")
        else:
            other = F.when(c.rlike(r"\p{IsHan}"), HAN).when(c.rlike(r"\p{IsHangul}"), HANGUL).when(c.rlike(r"[\p{L}\p{N}]"), ALPHABETS[1])
            own = F.coalesce(F.get(F.filter(listed, lambda a: (c != "") & a.contains(c)), F.lit(0)), other)
        return F.coalesce(F.substring(own, _drawn(stream, i, F.length(own)) + 1, F.lit(1)), c)

    return F.array_join(F.transform(_chars(value), one), "")


def _luhn(digits: Column) -> Column:
    """The sum of a number's digits, every second one from the right but one doubled."""
    parts = F.transform(_chars(F.reverse(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(parts, F.lit(0), lambda a, b: a + b)


def _mod97(value: Column) -> Column:
    """The remainder by 97 of digits and capital letters (A: 10 to Z: 35)."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(_chars(value), F.lit(0), step)


def surrogate(entity: Column, attempt: Column, secret: str) -> Column:
    """The surrogate of a `type|canonical form` key at an attempt; a pure function of both and the secret."""
    what, value = F.substring_index(entity, "|", 1), F.regexp_replace(entity, r"^[^|]*\|", "")
    seed = F.concat_ws("|", entity, attempt.cast("string"))
    stream = _stream(secret, seed, F.lit(31))
    masked = _masked(value, secret, seed)
    host = F.substring_index(value, "@", -1)
    labels = F.regexp_replace(host, r"\.[^.]*$", "")
    # Equal domains get equal surrogates, whatever the attempt.
    email = F.concat(_masked(F.substring_index(value, "@", 1), secret, seed), F.lit("@"), _masked(labels, secret, F.concat_ws("|", F.lit("domain"), host)), F.regexp_extract(host, r"\.[^.]*$", 0))
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(F.conv(F.substring(stream, i * 4 + 1, F.lit(4)), 16, 10).cast("int"), F.lit(254)) + 1).cast("string")), ".")
    kept = F.concat(F.substring(value, 1, 1), F.substring(masked, F.lit(2), F.length(value) - 2))
    check = F.pmod(F.lit(10) - _luhn(F.concat(kept, F.lit("0"))) % 10, F.lit(10)).cast("string")
    card = F.when(_luhn(value) % 10 == 0, F.concat(kept, check)).otherwise(F.concat(kept, F.substring(masked, -1, 1)))
    account = F.substring(masked, F.lit(5), F.length(value))
    checked = F.lpad((98 - _mod97(F.concat(account, F.substring(value, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    real = _mod97(F.concat(F.substring(value, F.lit(5), F.length(value)), F.substring(value, 1, 4))) == 1
    iban = F.concat(F.substring(value, 1, 2), F.when(real, checked).otherwise(F.substring(masked, 3, 2)), account)
    pick = lambda parts, i: F.element_at(F.array(*map(F.lit, parts)), _drawn(stream, i, F.lit(len(parts))) + 1)

    def built(script: str, last: list[str]) -> Column:
        first, middle, _ = SYLLABLES[script]
        # Each attempt adds a syllable, so there is always room for another name.
        inner = F.array_join(F.transform(F.sequence(F.lit(1), attempt.cast("int") + 1), lambda i: pick(middle, i % 19 + 1)), "")
        return F.concat(pick(first, F.lit(0)), inner, pick(last, F.lit(21)))

    given = None
    for group, names in GIVEN.items():
        test, name = what == f"given_{group}", F.when(attempt < NATURAL, pick(names, F.lit(0))).otherwise(built(group.split("_")[0], ENDINGS[group]))
        given = F.when(test, name) if given is None else given.when(test, name)
    cyrillic = F.concat(built("cyrillic", SYLLABLES["cyrillic"][2]), F.when(value.endswith("а"), "а").otherwise(""))
    surname = F.when(value.rlike(r"\p{IsCyrillic}"), cyrillic).when(value.rlike(r"\p{IsGreek}"), built("greek", SYLLABLES["greek"][2])).when(value.rlike(r"^[\p{IsLatin}'’-]+$"), built("latin", SYLLABLES["latin"][2])).otherwise(masked)
    prefix = r"^(?:AKIA|ASIA|ghp_|gho_|sk-|xox[bp]-)"
    hexadecimal = F.when(value.rlike(r"^[0-9A-Fa-f:]+$"), _masked(value, secret, seed, True)).otherwise(F.concat(F.regexp_extract(value, prefix, 0), _masked(F.regexp_replace(value, prefix, ""), secret, seed)))
    return (
        F.when(what == "email", email).when(what == "ip", ip).when(what == "card", card).when(what == "iban", iban)
        .when(what.isin("secret", "ip6"), hexadecimal).when(what == "surname", surname).when(what.startswith("given_"), given)
        .when(what == "phone", F.concat(F.substring(value, 1, 1), F.substring(masked, F.lit(2), F.length(value)))).otherwise(masked)
    )


def token(entity: Column, secret: str) -> Column:
    """What an entity gets whose form leaves no room for a surrogate: its type and a keyed digest."""
    return F.concat(F.lit("["), F.upper(F.substring_index(entity, "|", 1)), F.lit("-"), F.substring(keyed(secret, entity), 1, 32), F.lit("]"))


def surrogates(entities: DataFrame, secret: str) -> DataFrame:
    """`entity` and `surrogate` for the different keys in column `entity`, all surrogates distinct and new."""
    # Short rows but long work: dealt by number, since by size they would all go to one task.
    partitions = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    real = checkpoint(entities.select("entity").distinct().repartition(partitions, "entity"))
    mark = F.concat_ws("|", F.substring_index("entity", "|", 1), "surrogate")
    taken, live, done = real.select(F.col("entity").alias("mark")), real, None
    for attempt in range(ROUNDS):
        drawn = live.withColumn("surrogate", surrogate(F.col("entity"), F.lit(attempt), secret)).withColumn("mark", mark)
        order = Window.partitionBy("mark").orderBy(F.xxhash64("entity"), "entity")
        ranked = drawn.withColumn("turn", F.row_number().over(order)).join(taken.withColumn("real", F.lit(True)), "mark", "left")
        judged = checkpoint(ranked.select("entity", "surrogate", "mark", ((F.col("turn") > 1) | F.col("real").isNotNull()).alias("again")))
        settled = judged.filter("not again")
        done = settled.select("entity", "surrogate") if done is None else done.unionByName(settled.select("entity", "surrogate"))
        taken = taken.unionByName(settled.select("mark"))
        live = judged.filter("again").select("entity")
        if live.isEmpty():
            return done
    return done.unionByName(live.select("entity", token(F.col("entity"), secret).alias("surrogate")))


def _rendered(mention: Column, found: Column) -> Column:
    """A mention with the surrogates of its keys, in its own format."""
    what, value = kind(mention), F.element_at(F.map_values(found), 1)
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))
    takes = lambda a, c: F.struct(F.concat(a["out"], F.when(c.rlike("[0-9A-Z]"), F.substring(value, a["next"], F.lit(1))).otherwise(c)).alias("out"), (a["next"] + c.rlike("[0-9A-Z]").cast("int")).alias("next"))
    filled = F.when(value.startswith("["), value).otherwise(F.aggregate(_chars(mention), start, takes, lambda a: a["out"]))

    def word(part: Column) -> Column:
        new = F.try_element_at(found, token_key(part))
        return F.when(new.isNull(), part).when(_upper(part), F.upper(new)).otherwise(new)

    names = F.array_join(F.transform(F.split(mention, " "), word), " ")
    shouted = F.when(F.upper(mention) == mention, F.upper(value)).otherwise(value)
    return F.when(what == "name", names).when(what.isin("iban", *DIGITS), filled).when(what == "email", shouted).otherwise(value)


def rendered_mentions(found: DataFrame, secret: str) -> DataFrame:
    """`mention` and `new`, its replacement, for the different values of column `mention`."""
    each = stored(found.select("mention").distinct().select("mention", F.explode(keys(F.col("mention"))).alias("entity")).distinct())
    own = spread_join(each, surrogates(each, secret), ["entity"])
    own = own.groupBy("mention").agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("own"))  # a key for each word at most
    return own.select("mention", _rendered(F.col("mention"), F.col("own")).alias("new"))


def _names(own: Column) -> Column:
    """Word by word what the names among a text's mentions become; forms of address and other types are left out."""
    words = lambda e: F.filter(F.arrays_zip(F.split(e["key"], " ").alias("word"), F.split(e["value"], " ").alias("new")), lambda x: x["word"].isNotNull() & x["new"].isNotNull() & (x["word"] != x["new"]) & x["word"].rlike(rf"^{_PART}$"))
    named_ = F.filter(F.map_entries(own), lambda e: kind(e["key"]) == "name")
    return F.map_from_entries(F.array_distinct(F.flatten(F.transform(named_, words))))


def _with_names(text: Column, names: Column) -> Column:
    """A stretch of text between mentions with every word replaced that is part of a name found elsewhere in the text."""
    words = F.split(text, r"(?<![\p{L}'’-])(?=[\p{L}])|(?<=[\p{L}'’-])(?![\p{L}'’-])")

    def new(word: Column) -> Column:
        base = F.regexp_replace(word, "['’]s?$", "")  # a genitive keeps its ending
        found = F.coalesce(F.try_element_at(names, base), F.when(_upper(base), F.upper(F.try_element_at(names, F.initcap(base)))))
        return F.coalesce(F.concat(found, F.substring(word, F.length(base) + 1, F.length(word))), word)

    return F.when(F.size(names) > 0, F.array_join(F.transform(words, new), "")).otherwise(text)


def pseudonymise(df: DataFrame, secret: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """`df` with the entities of `text_col` replaced, and their number in `count_col` if it is named."""
    columns = df.columns
    at = f"c{columns.index(text_col)}"
    text = F.col(at)
    marked = stored(positional(df).withColumn("found", mentions(F.coalesce(text, F.lit("")))))
    last = f"c{len(columns)}"
    count = {last: F.size("found").cast("long")} if count_col else {}
    clean = marked.filter(F.size("found") == 0).withColumns(count)
    held = marked.filter(F.size("found") > 0).withColumns({"h1": F.xxhash64(at), "h2": F.xxhash64(at, F.lit(1))})
    each = stored(held.select("h1", "h2", F.explode(F.array_distinct("found")).alias("mention")).distinct())
    new = spread_join(each, rendered_mentions(each, secret), ["mention"])
    own = new.groupBy("h1", "h2").agg(F.map_from_entries(F.collect_list(F.struct("mention", "new"))).alias("own"))
    pieces = F.zip_with(F.split(text, PATTERN, -1), F.transform("found", lambda m: F.try_element_at("own", m)), lambda a, b: F.concat(_with_names(a, F.col("names")), F.coalesce(b, F.lit(""))))
    replaced = spread_join(held, own.withColumn("names", _names(F.col("own"))), ["h1", "h2"]).withColumn(at, F.array_join(pieces, "")).withColumns(count)
    names = [*columns, count_col] if count_col else columns
    return named(clean, names).unionByName(named(replaced, names))
