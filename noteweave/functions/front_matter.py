"""The front matter of a note, read line by line with a stack of indentations.

What notes use of YAML: maps and lists, nested and inline, plain and quoted scalars, block scalars, comments, and typed
scalars (null, booleans, whole and decimal numbers; dates stay text). Anchors, tags and several documents are errors.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = re.compile(r"^-{3,}[ \t]*$", re.M)
WORDS = {"": None, "~": None, "null": None, "Null": None, "NULL": None} | {w: v for v, own in ((True, ("true", "yes", "on")), (False, ("false", "no", "off"))) for x in own for w in (x, x.title(), x.upper())}
INT, FLOAT = re.compile(r"[-+]?[0-9]+"), re.compile(r"[-+]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/"}


class Malformed(ValueError):
    pass


def split(text: str) -> tuple[str | None, str]:
    """The front matter (None: there is none, or it does not end) and the body."""
    text = text.replace("\r\n", "\n").strip()
    parts = FENCE.split(text, maxsplit=2) if FENCE.match(text) else []
    return (parts[1], parts[2].strip()) if len(parts) == 3 else (None, text)


def scalar(text: str):
    """A plain scalar with its type."""
    if text in WORDS:
        return WORDS[text]
    if text[0] in "&*!%@`|>":
        raise Malformed(f"unsupported value {text!r}")
    if ": " in text or text.endswith(":"):
        raise Malformed(f"a map inside the value {text!r}")
    return int(text) if INT.fullmatch(text) else float(text) if FLOAT.fullmatch(text) else text


class Inline:
    """Quoted scalars, inline lists and inline maps at the head of a text."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at] in " \t\n":
            self.at += 1

    def quoted(self) -> str:
        mark, out, self.at = self.text[self.at], [], self.at + 1
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 1
            if c == mark and mark == "'" and self.text[self.at : self.at + 1] == "'":
                out.append("'")
                self.at += 1
            elif c == mark:
                return "".join(out)
            elif c == "\\" and mark == '"':
                out.append(ESCAPES.get(self.text[self.at : self.at + 1], self.text[self.at : self.at + 1]))
                self.at += 1
            else:
                out.append(c)
        raise Malformed("a quote without end")

    def value(self, stops: str):
        self.space()
        c = self.text[self.at : self.at + 1]
        if c and c in "'\"":
            return self.quoted()
        if c == "[":
            return [v for _, v in self.items("]", False)]
        if c == "{":
            return dict(self.items("}", True))
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in stops and not (":" in stops and self.text[self.at : self.at + 2] == ": "):
            self.at += 1
        return scalar(self.text[start : self.at].strip())

    def items(self, end: str, keyed: bool):
        self.at += 1
        while True:
            self.space()
            if self.text[self.at : self.at + 1] == end:
                self.at += 1
                return
            key = self.value(",:" + end) if keyed else None
            self.space()
            if keyed and self.text[self.at : self.at + 1] == ":":
                self.at += 1
                value = self.value("," + end)
            else:
                value = None if keyed else self.value("," + end)
            yield key, value
            self.space()
            mark = self.text[self.at : self.at + 1]
            if mark == ",":
                self.at += 1
            elif mark != end:
                raise Malformed("an inline list or map without end")


def inline(text: str):
    """The value that stands after a key or a dash, comments cut off."""
    if text[:1] and text[0] in "'\"[{":
        read = Inline(text)
        out = read.value("")
        rest = text[read.at :].strip()
        if rest and not (rest.startswith("#") and text[read.at] in " \t"):
            raise Malformed(f"{rest!r} after a value")
        return out
    return scalar(re.split(r"(?:^|[ \t])#", text, maxsplit=1)[0].strip())


KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#\[\]{}"'&*!|>%@`,-][^#]*?|-[^\s][^#]*?)[ \t]*:(?:[ \t]+(.*))?$""")
BLOCK = re.compile(r"([|>])([-+]?)[0-9]?[ \t]*(?:#.*)?$")


class Lines:
    """Blocks by indentation: each call of `block` reads one map, list or scalar that stands deeper than its parent."""

    def __init__(self, text: str):
        self.lines, self.at = text.split("\n"), 0

    def peek(self) -> tuple[int, str] | None:
        while self.at < len(self.lines):
            line = self.lines[self.at]
            bare = line.strip()
            if bare and not bare.startswith("#"):
                indent = len(line) - len(line.lstrip(" "))
                if line[indent] == "\t":
                    raise Malformed("a tab as indentation")
                return indent, line[indent:].rstrip()
            self.at += 1
        return None

    def block(self, least: int):
        head = self.peek()
        if head is None or head[0] < least:
            return None
        indent, text = head
        if text == "-" or text.startswith("- "):
            return self.sequence(indent)
        return self.mapping(indent) if KEY.match(text) else self.text(indent)

    def text(self, indent: int):
        out = []
        while (head := self.peek()) and head[0] >= indent:
            out.append(head[1])
            self.at += 1
        return inline(" ".join(out))

    def mapping(self, indent: int) -> dict:
        out = {}
        while (head := self.peek()) and head[0] >= indent:
            found = KEY.match(head[1])
            if head[0] > indent or not found:
                raise Malformed(f"line {self.at + 1} is no key of its map")
            key, rest = found.group(1), (found.group(2) or "").strip()
            key = Inline(key).quoted() if key[0] in "'\"" else key.strip()
            self.at += 1
            out[key] = self.after(rest, indent, True)
        return out

    def sequence(self, indent: int) -> list:
        out = []
        while (head := self.peek()) and head[0] == indent and (head[1] == "-" or head[1].startswith("- ")):
            rest = head[1][1:].lstrip()
            if KEY.match(rest) and rest[0] not in "'\"[{":  # a map whose first key stands behind the dash
                deeper = indent + len(head[1]) - len(rest)
                self.lines[self.at] = " " * deeper + rest
                out.append(self.mapping(deeper))
            else:
                self.at += 1
                out.append(self.after(rest, indent, False))
        if (head := self.peek()) and head[0] > indent:
            raise Malformed(f"line {self.at + 1} is no item of its list")
        return out

    def after(self, rest: str, indent: int, of_key: bool):
        """What stands behind a key or a dash, or below it."""
        found = BLOCK.match(rest)
        if found:
            return self.scalar_block(indent, *found.groups())
        if not rest or rest.startswith("#"):
            head = self.peek()
            if of_key and head and head[0] == indent and (head[1] == "-" or head[1].startswith("- ")):
                return self.sequence(indent)  # the items of a list may stand under its key without indentation
            return self.block(indent + 1)
        lines = [rest]
        opens = rest[0] in "[{\"'"
        while (head := self.peek()) and head[0] > indent and (opens or not KEY.match(head[1])):
            if opens:
                try:
                    inline("\n".join(lines))
                    break
                except Malformed:
                    pass
            lines.append(head[1])
            self.at += 1
        return inline(("\n" if opens else " ").join(lines))

    def scalar_block(self, indent: int, kind: str, chomp: str) -> str:
        own, deep = [], None
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if line.strip():
                here = len(line) - len(line.lstrip(" "))
                if here <= indent:
                    break
                deep = here if deep is None else deep
            own.append(line[deep or 0 :] if line.strip() else "")
            self.at += 1
        body = "\n".join(own).rstrip("\n")
        if kind == ">":
            body = re.sub(r"(?<=\S)\n(?=\S)", " ", body)
            body = re.sub(r"\n(\n+)", r"\1", body)
        return body + {"-": "", "": "\n" if body else "", "+": "\n" * (1 + len(own) - len("\n".join(own).rstrip("\n").split("\n")))}[chomp]


def parse(text: str):
    """The value of a front matter; a Malformed error where it has none."""
    lines = Lines(text)
    out = lines.block(0)
    if lines.peek() is not None:
        raise Malformed(f"line {lines.at + 1} belongs to nothing")
    return out


def shown(value) -> str:
    """A value as the metadata store has it: lists joined by a bar, nothing as an empty text."""
    if isinstance(value, list):
        return "|".join(shown(v) for v in value)
    return "" if value is None else json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else str(value)


RESULT = "struct<json string, fields map<string, string>, error string, body string>"


def read(raw: Column) -> Column:
    """Of a note's text: the metadata as `json` (null: none), each field as text, the `error` of an unparsable front matter, the `body`."""

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts.tolist():
            matter, body = split(text or "")
            try:
                found, error = parse(matter) if matter is not None else None, None
            except (Malformed, RecursionError) as problem:
                found, error = None, str(problem) or "nested too deeply"
            found = found if isinstance(found, dict) and found else None  # anything else is no metadata
            rows.append((None if found is None else json.dumps(found, ensure_ascii=False, default=str), {str(k): shown(v) for k, v in (found or {}).items()}, error, body))
        return pd.DataFrame(rows, columns=["json", "fields", "error", "body"])

    return run(raw)
