"""Timed captions (.srt, .vtt): cues, paragraphs, sections and transcripts, in DataFrame terms.

Folds that start anew by their own state (a paragraph's length, a section's start) are one linear pass over a file's ordered
cues, in Arrow batches; a file's cues are one array, as its transcript is one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import clock, cue_text, seconds, strip

GAP_SECONDS, PARAGRAPH_CHARS, SECTION_SECONDS, LABEL_WORDS = 2.0, 400, 180.0, 8
STAMP = r"(\d{2}:\d{2}:\d{2}[.,]\d{3}|\d{2}:\d{2}[.,]\d{3})"
TIMING = rf"{STAMP}\s*-->\s*{STAMP}"
CUE = "struct<start_s:double,end_s:double,text:string>"
PARAGRAPHS = T.ArrayType(T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("text", T.StringType())]))
PARTS = pa.list_(pa.struct([("start_s", pa.float64()), ("text", pa.string())]))


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 without its mark, or, if they aren't that, as Latin-1."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    return F.regexp_replace(F.coalesce(utf8, F.decode(content, "ISO-8859-1")), "^﻿", "")


def _blocks(text: Column) -> Column:
    """Runs of lines between blank ones, each line stripped."""
    plain = F.regexp_replace(text, r"\r\n|\r", "\n")
    bare = F.array_join(F.transform(F.split(plain, "\n"), strip), "\n")
    return F.transform(F.filter(F.split(bare, "\n{2,}"), lambda b: b != ""), lambda b: F.filter(F.split(b, "\n"), lambda x: x != ""))


def _cue(block: Column) -> Column:
    """A block's times and clean text; times are null where its first arrow line has none."""
    at = F.array_position(F.transform(block, lambda x: x.contains("-->")), True).cast("int")
    line = F.get(block, at - 1)
    body = F.filter(F.transform(F.slice(block, at + 1, F.size(block)), cue_text), lambda x: x != "")
    stamp = lambda i: F.when(line.rlike(TIMING), seconds(F.regexp_extract(line, TIMING, i)))
    return F.struct(stamp(1).alias("start_s"), stamp(2).alias("end_s"), F.array_join(body, " ").alias("text")).cast(CUE)


def cues(files: DataFrame) -> DataFrame:
    """(path, cues, timed) of files(path, text): cues in order, and whether any timing line was seen."""
    arrows = F.filter(_blocks(F.col("text")), lambda b: F.exists(b, lambda x: x.contains("-->")))
    made = files.withColumn("__blocks", arrows).withColumn("__cues", F.transform("__blocks", _cue))
    timed = F.filter("__cues", lambda c: c["start_s"].isNotNull())
    return made.select("path", F.filter(timed, lambda c: c["text"] != "").alias("cues"), (F.size(timed) > 0).alias("timed"))


def without_repeats(cue_array: Column) -> Column:
    """Cues whose text isn't that of the cue before."""
    return F.filter(cue_array, lambda c, i: (i == 0) | (c["text"] != F.get(cue_array, F.greatest(i - 1, F.lit(0)))["text"]))


@F.arrow_udf(PARAGRAPHS)
def paragraphs(cue_arrays: pa.Array) -> pa.Array:
    """Paragraphs with their start, of arrays of cues: one ends after a pause, or before it would be too long."""

    def folded(cue_array: list[dict]) -> Iterator[dict]:
        opened, ended, held, size = None, None, [], 0
        for c in cue_array:
            if held and (c["start_s"] - ended > GAP_SECONDS or size + len(c["text"]) > PARAGRAPH_CHARS):
                yield {"start_s": opened, "text": " ".join(held)}
                held, size = [], 0
            opened = opened if held else c["start_s"]
            held.append(c["text"])
            ended, size = c["end_s"], size + len(c["text"])
        if held:
            yield {"start_s": opened, "text": " ".join(held)}

    return pa.array([None if x is None else list(folded(x)) for x in cue_arrays.to_pylist()], PARTS)


@F.arrow_udf(T.ArrayType(PARAGRAPHS))
def sections(para_arrays: pa.Array) -> pa.Array:
    """Arrays of paragraphs: a section starts where a paragraph is SECTION_SECONDS or more after the section's start."""

    def folded(paras: list[dict]) -> Iterator[list[dict]]:
        held: list[dict] = []
        for p in paras:
            if held and p["start_s"] - held[0]["start_s"] >= SECTION_SECONDS:
                yield held
                held = []
            held.append(p)
        if held:
            yield held

    return pa.array([None if x is None else list(folded(x)) for x in para_arrays.to_pylist()], pa.list_(PARTS))


def section_text(section: Column) -> Column:
    """A section as Markdown: its time and first words, then its paragraphs with their times."""
    stamp = lambda s: F.concat(F.lit("["), clock(s), F.lit("]"))
    first = F.get(section, F.lit(0))
    label = F.array_join(F.slice(F.filter(F.split(first["text"], r"\s+"), lambda w: w != ""), 1, LABEL_WORDS), " ")
    body = F.array_join(F.transform(section, lambda p: F.concat(stamp(p["start_s"]), F.lit(" "), p["text"])), "\n\n")
    return F.concat(F.lit("## "), stamp(first["start_s"]), F.lit(" "), label, F.lit("\n\n"), body)


def transcripts(files: DataFrame) -> DataFrame:
    """(path, text, status, reason, pages) of files(path, text): pages is the number of sections.

    A file without cues is a stub: no-cues if it has timing lines, malformed if not."""
    made = cues(files).withColumn("sections", sections(paragraphs(without_repeats(F.col("cues")))))
    ok = F.size("cues") > 0
    return made.select(
        "path", F.when(ok, F.array_join(F.transform("sections", section_text), "\n\n")).otherwise("").alias("text"), F.when(ok, "ok").otherwise("stub").alias("status"),
        F.when(ok, "").when(F.col("timed"), "no-cues").otherwise("malformed").alias("reason"), F.size("sections").alias("pages"),
    )
