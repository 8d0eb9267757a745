"""Text functions as columns: tokenizers, headings, lines, paths, time codes. All but NFKC run in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Word characters as both Spark and an ANSI engine's RE2 see them (their \w is ASCII only).
WORD = r"[\p{L}\p{N}_]"
#: White space as Python's str.strip() takes it.
BLANK = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Where lines end, as Python's str.splitlines() takes it.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
#: Where an identifier has its inner boundaries.
INNER = r"[_\-.]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
#: Kana, ideographs with their extensions, syllables and compatibility forms.
CJK = r"\u3040-\u309f\u30a0-\u30ff\u3100-\u312f\u31a0-\u31bf\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff\x{20000}-\x{2ebef}"
MODES = ("plain", "code", "cjk")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition; Spark has no function for it."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def _code_parts(word: Column) -> Column:
    whole = F.lower(word)
    parts = F.filter(F.split(word, INNER), lambda p: p != "")
    inner = F.filter(F.transform(parts, F.lower), lambda p: p != whole)
    return F.concat(F.array(whole), F.when(F.size(parts) >= 2, inner).otherwise(F.array().cast("array<string>")))


def _pairs(run: Column) -> Column:
    """Overlapping pairs of characters of a CJK run, or its one character; any other piece as it is."""
    last = F.length(run) - 1
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
    return F.when(run.rlike(f"^[{CJK}]") & (last >= 1), pairs).otherwise(F.array(run))


def tokens(text: Column, mode: str = "plain") -> Column:
    """Words of a text as an array; null counts as empty.

    plain: lower case. code: each word, then its parts at separators and case changes. cjk: compatibility form in lower
    case, CJK runs as overlapping pairs.
    """
    text = F.coalesce(text, F.lit(""))
    if mode == "plain":
        return F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}+"), F.lit(0))
    if mode == "code":
        return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(f"{WORD}+"), F.lit(0)), _code_parts))
    if mode == "cjk":
        pieces = F.regexp_extract_all(F.lower(nfkc(text)), F.lit(rf"[{CJK}]+|[\p{{L}}\p{{N}}_&&[^{CJK}]]+"), F.lit(0))
        return F.flatten(F.transform(pieces, _pairs))
    raise ValueError(f"tokenizer mode {mode!r} is none of {MODES}")


def cjk_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[{CJK}]")), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of word characters."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def lines(text: Column) -> Column:
    """Lines of a text without their ends; an end after the last line makes no further line."""
    parts = F.split(text, LINE_END)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(whole)


def is_heading(line: Column) -> Column:
    """A Markdown heading, or a line of letters and spaces from a capital to a final colon."""
    bare = strip(line)
    return bare.rlike(r"^#{1,6}\s+\S") | bare.rlike(r"^[A-Z][A-Za-z ]+:$")


def heading_text(line: Column) -> Column:
    bare = strip(line)
    marked = strip(F.regexp_replace(bare, r"^#{1,6}\s+", ""))
    return F.when(bare.rlike(r"^#{1,6}\s+\S"), marked).otherwise(strip(F.regexp_replace(bare, ":$", "")))


def title(line_array: Column, fallback: Column) -> Column:
    """The first line that is not blank."""
    return F.coalesce(F.get(F.filter(F.transform(line_array, strip), lambda x: x != ""), F.lit(0)), fallback)


def first_sentence(text: Column) -> Column:
    """Up to the first sentence end, or the whole text; at most 120 characters."""
    found = F.regexp_extract(text, r"[^.!?]*[.!?]", 0)
    return F.substring(strip(F.when(found != "", found).otherwise(text)), 1, 120)


def suffix(path: Column) -> Column:
    """Extension in lower case with its dot, as a path library sees it: none for a name that starts with its only dot."""
    return F.lower(F.regexp_extract(basename(path), r"^(?:.*[^.])(\.[^.]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def one_line(text: Column, limit: int = 160) -> Column:
    """Line breaks written out, cut with three dots."""
    flat = F.replace(text, F.lit("\n"), F.lit("\\n"))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("..."))).otherwise(flat)


def seconds(stamp: Column) -> Column:
    """Seconds of HH:MM:SS,mmm, HH:MM:SS.mmm or MM:SS.mmm."""
    parts = F.split(F.replace(strip(stamp), F.lit(","), F.lit(".")), ":")
    at = lambda i: F.element_at(parts, F.lit(i))
    hours = F.when(F.size(parts) == 3, at(1).cast("int")).otherwise(0)
    return hours * 3600 + at(-2).cast("int") * 60 + at(-1).cast("double")


def clock(value: Column) -> Column:
    """Whole seconds as HH:MM:SS."""
    total = F.floor(value).cast("int")
    return F.format_string("%02d:%02d:%02d", F.floor(total / 3600).cast("int"), F.floor(total % 3600 / 60).cast("int"), total % 60)


def cue_text(line: Column) -> Column:
    """A caption line without position codes and markup; a voice tag becomes a `Speaker: ` prefix."""
    bare = F.regexp_replace(line, r"(?i)\{\\an?\d+\}", "")
    speaker = strip(F.regexp_replace(F.regexp_extract(bare, r"<v(?:\.[^ >]*)?\s+([^>]+)>", 1), "<[^>]*>", ""))
    said = strip(F.regexp_replace(F.regexp_replace(bare, r"<v(?:\.[^ >]*)?\s+[^>]+>", ""), "<[^>]*>", ""))
    voiced = bare.rlike(r"<v(?:\.[^ >]*)?\s+[^>]+>")
    spoken = F.when(voiced, F.when(said != "", F.concat(speaker, F.lit(": "), said)).otherwise(F.concat(speaker, F.lit(":")))).otherwise(F.regexp_replace(bare, "<[^>]*>", ""))
    return strip(F.regexp_replace(spoken, r"[ \t]{2,}", " "))


def unwrapped(text: Column) -> Column:
    """Page text with plain line ends, words joined over a line's hyphen, in compatibility form."""
    plain = F.regexp_replace(text, r"\r\n|\r", "\n")
    return nfkc(F.regexp_replace(plain, rf"({WORD})-\n({WORD})", "$1$2"))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """A vector of length 1; one without a length stays as it is."""
    norm = F.sqrt(dot(vector, vector))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def same_path(a: Column, b: Column) -> Column:
    """Equal paths, or one the end of the other from a folder on."""
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))


def capped(text: Column, limit: int) -> Column:
    """A text cut to so many UTF-8 bytes, at a character's end."""
    head = F.substring(F.encode(text, "UTF-8"), 1, limit)
    cut = F.coalesce(*(F.try_validate_utf8(F.substring(head, F.lit(1), F.length(head) - k).cast("string")) for k in range(4)))
    return F.when(F.octet_length(text) <= limit, text).otherwise(cut)
