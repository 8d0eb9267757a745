"""Gettext catalogues: one record for each live entry, parsed on the executors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = "msgid string, msgstr string, start_line int, end_line int, msgid_line int, msgctxt string, msgid_plural string, msgstr_plural array<string>, flags array<string>, references array<string>"
_STATEMENT = re.compile(r"(msgctxt|msgid_plural|msgid|msgstr)(?:\[(\d+)\])?\s*(.*)")
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


def unescaped(literal: str) -> str:
    """The text of a quoted literal; an escape that PO doesn't know stays as it is written."""
    body = literal.strip()
    if body[:1] == '"':
        body = body[1:]
        slashes = len(body) - 1 - len(body[:-1].rstrip("\\"))
        if body[-1:] == '"' and slashes % 2 == 0:
            body = body[:-1]
    return re.sub(r"(?s)\\(.)", lambda m: _PLAIN.get(m[1], m[0]), body)


def entries(text: str) -> Iterator[dict]:
    """Entries in the order of the file, the header among them; obsolete ones (#~) are passed over. Never raises."""
    fresh = lambda: {"first": 0, "last": 0, "id_line": 0, "parts": {}, "plural": {}, "flags": [], "refs": [], "open": None, "answered": False}
    state = fresh()

    def closed(s: dict) -> list[dict]:
        if "msgid" not in s["parts"]:
            return []
        plural = [x for _, x in sorted(s["plural"].items())]
        part = s["parts"].get
        return [{"msgid": part("msgid"), "msgstr": "\n".join(plural) if plural else part("msgstr", ""), "start_line": s["first"], "end_line": s["last"], "msgid_line": s["id_line"], "msgctxt": part("msgctxt"), "msgid_plural": part("msgid_plural"), "msgstr_plural": plural, "flags": s["flags"], "references": s["refs"]}]

    def add(s: dict, literal: str) -> None:
        where, key = s["open"]
        s[where][key] = s[where].get(key, "") + unescaped(literal)

    for n, raw in enumerate(text.removeprefix("﻿").splitlines(), 1):
        line = raw.strip()
        if not line:
            yield from closed(state)
            state = fresh()
            continue
        statement = _STATEMENT.match(line)
        remark = line[0] == "#"
        if line.startswith("#~") or not (remark or statement or line[0] == '"'):
            continue
        # a remark, or what begins an entry, after a translation begins the next one
        if state["answered"] and (remark or (statement and line[0] != '"' and statement[1] in ("msgid", "msgctxt"))):
            yield from closed(state)
            state = fresh()
        if line[0] == '"' and state["open"] is None:
            continue
        state["first"] = state["first"] or n
        state["last"] = n
        if remark:
            if line[1:2] == ":":
                state["refs"] += line[2:].split()
            elif line[1:2] == ",":
                state["flags"] += [x.strip() for x in line[2:].split(",") if x.strip()]
        elif line[0] == '"':
            add(state, line)
        else:
            name, index, rest = statement.groups()
            state["open"] = ("plural", int(index)) if name == "msgstr" and index else ("parts", name)
            state["answered"] |= name == "msgstr"
            if name == "msgid":
                state["id_line"] = n
            add(state, rest)
    yield from closed(state)


def parse(files: DataFrame) -> DataFrame:
    """(path, ENTRY) of files(path, text): a row for each live entry."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", *(x.split()[0] for x in ENTRY.split(", "))]
        for batch in batches:
            rows = [{"path": p} | e for p, t in zip(batch["path"], batch["text"], strict=True) for e in entries(t or "")]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "text").mapInPandas(run, f"path string, {ENTRY}")


def translated() -> Column:
    """Whether an entry has a translation: all of its plural forms, if it has such."""
    return F.when(F.size("msgstr_plural") > 0, ~F.exists("msgstr_plural", lambda x: x == "")).otherwise(F.col("msgstr") != "")


def documents(parsed: DataFrame) -> DataFrame:
    """(docid, text, url, source_path, start_line, end_line, context, metadata) of parse()'s rows, without headers.

    metadata is JSON, without the fields that an entry lacks."""
    live = parsed.where((F.col("msgid") != "") | F.col("msgctxt").isNotNull())
    parts = [F.when(F.col(c) != "", F.col(c)) for c in ("msgctxt", "msgid", "msgid_plural", "msgstr")]
    plural = F.when(F.col("msgid_plural").isNotNull(), F.col("msgstr_plural"))
    meta = F.struct(F.lit("po").alias("kind"), "msgid", "msgstr", F.array_contains("flags", "fuzzy").alias("fuzzy"), translated().alias("translated"), F.col("msgid_line").alias("line"), "references", "msgctxt", "msgid_plural", plural.alias("msgstr_plural"))
    return live.select(
        F.concat("path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")).alias("docid"),
        F.concat_ws("\n", *parts).alias("text"), F.lit("").alias("url"), F.col("path").alias("source_path"), "start_line", "end_line", F.lit("").alias("context"), F.to_json(meta).alias("metadata"),
    )
