"""Chunking: paragraphs and headings of texts, folded into chunks of a target size; breadcrumbs and context."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import first_sentence, strip, suffix
from quarry.operators.scoring import slices

PROSE = (".md", ".markdown", ".txt", ".rst")
CONFIG = (".yaml", ".yml", ".toml", ".json", ".ini", ".cfg", ".tf", ".tfvars", ".hcl")
#: Grammar of each code suffix.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "tsx", ".java": "java",
    ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".cs": "csharp",
    ".kt": "kotlin", ".scala": "scala", ".swift": "swift", ".lua": "lua", ".sh": "bash", ".bash": "bash",
}

#: The space characters (Zs) that a whole text loses at its ends.
SPACES = " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

#: Bytes of text that a fold in Python takes at once, or one text.
BYTES = 1 << 22

_MARKED = re.compile(r"#{1,6}\s+(?=\S)")
_LABEL = re.compile(r"[A-Z][A-Za-z ]+:")


@dataclass(frozen=True)
class ChunkingPolicy:
    """Target sizes in characters by kind of file; ast_max: most non-blank characters of a syntax chunk."""

    prose_chars: int = 400
    config_chars: int = 400
    code_chars: int = 400
    default_chars: int = 400
    ast_max_chars: int = 1200

    def to_dict(self) -> dict[str, int]:
        return asdict(self)

    @classmethod
    def from_dict(cls, data: dict) -> ChunkingPolicy:
        return cls(**{k: v for k, v in data.items() if k in cls.__dataclass_fields__})

    def target(self, path: Column) -> Column:
        """The target size of a path's kind of file."""
        end = suffix(path)
        return F.when(end.isin(*PROSE), self.prose_chars).when(end.isin(*CONFIG), self.config_chars).when(end.isin(*LANGUAGES), self.code_chars).otherwise(self.default_chars)


def language(path: Column) -> Column:
    """The grammar of a path's suffix, null if it has none."""
    out = F.lit(None).cast("string")
    for end, name in sorted(LANGUAGES.items(), key=lambda x: len(x[0])):
        out = F.when(F.endswith(F.lower(path), F.lit(end)), name).otherwise(out)
    return out


@dataclass(frozen=True)
class Paragraph:
    """A run of lines under a heading; heading_line is where that heading stands, if there is one."""

    heading: str
    text: str
    first: int
    last: int
    heading_line: int | None


def heading_of(bare: str) -> str | None:
    """The text of a heading line, or None: Markdown marks, or letters and spaces from a capital to a final colon."""
    if m := _MARKED.match(bare):
        return bare[m.end() :].strip()
    return bare[:-1].strip() if _LABEL.fullmatch(bare) else None


def paragraphs_of(line_list: list[str]) -> Iterator[Paragraph]:
    """Paragraphs of lines: runs of lines, stripped and joined by spaces, that a blank line or heading ends."""
    heading, heading_line, held, first = "", None, [], 0
    for n, line in enumerate([*line_list, ""], 1):
        bare = line.strip()
        found = heading_of(bare) if bare else None
        if bare and found is None:
            first = first if held else n
            held.append(bare)
            continue
        if held:
            yield Paragraph(heading, " ".join(held), first, n - 1, heading_line)
            held = []
        if found is not None:
            heading, heading_line = found, n


def chunks_of(text: str, target: int) -> list[tuple[str, str, int, int]]:
    """(heading, text, first line, last line): a chunk ends where the heading changes, or where one more paragraph would
    take it past the target. A paragraph is never cut; blank texts have no chunk, headings alone are one."""
    line_list = text.splitlines()
    if not text.strip():
        return []
    out, held, size = [], [], 0

    def close() -> None:
        if held:
            out.append((held[0][1].heading, " ".join(p.text for _, p in held), held[0][0], held[-1][1].last))

    for p in paragraphs_of(line_list):
        turn = not held or held[-1][1].heading != p.heading
        if turn or size + len(p.text) > target:
            close()
            held, size = [], 0
        start = p.first if not turn or p.heading_line is None else p.heading_line
        held.append((start, p))
        size += len(p.text)
    close()
    return out or [("", text.strip(), 1, len(line_list))]


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (doc_id, text, ...) cut to so few rows that a fold's lines and results stay small, however long texts are."""
    for batch in batches:
        for a, b in slices(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), BYTES):
            yield batch.slice(a, b - a)


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, heading, text, first, last, heading_line) of docs(doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            rows = [(doc, p) for doc, x in zip(batch.column(0), batch.column(1), strict=True) for p in paragraphs_of((x.as_py() or "").splitlines())]
            fields = [pa.array([getattr(p, f) for _, p in rows], t) for f, t in (("heading", pa.string()), ("text", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("heading_line", pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array([d.as_py() for d, _ in rows], batch.column(0).type), *fields], ["doc_id", "heading", "text", "first", "last", "heading_line"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, heading string, text string, first int, last int, heading_line int")


def whole(docs: DataFrame) -> DataFrame:
    """chunks() of texts that are never cut: each that isn't empty is one chunk without a heading.

    Its lines end at line feeds only and are put together by spaces as they are, the text without the space characters
    around it; the title is the first line as it is."""
    text = F.col("text").cast("string")
    return docs.where(F.length(text) > 0).select(
        F.concat(F.col("doc_id").cast("string"), F.lit("_0")).alias("id"), "doc_id", F.substring_index(text, "\n", 1).alias("doc_title"), F.lit("").alias("heading"),
        F.btrim(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit(SPACES)).alias("text"), F.lit(0).alias("position"), F.lit(1).alias("start_line"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).alias("end_line"),
    )


def chunks(docs: DataFrame, target: Column | int | None = 400) -> DataFrame:
    """(id, doc_id, doc_title, heading, text, position, start_line, end_line) of docs(doc_id, text).

    A text of blanks, or null, has no chunk; one of headings only is one chunk of the whole text. A paragraph is never cut.
    The fold keeps state from line to line, so it is one pass in Python over Arrow batches. Without a target, texts are
    whole()."""
    if target is None:
        return whole(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["id", "doc_id", "doc_title", "heading", "text", "position", "start_line", "end_line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            rows = []
            for doc, x, most in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = x.as_py() or ""
                name = next((b for b in map(str.strip, text.splitlines()) if b), str(doc))
                rows += [(f"{doc}_{k}", doc, name, h, t, k, a, b) for k, (h, t, a, b) in enumerate(chunks_of(text, most))]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            types = [pa.string(), batch.column(0).type, pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    size = F.lit(target) if isinstance(target, int) else target
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), size.cast("int").alias("target"))
    return rows.mapInArrow(run, f"id string, doc_id {kind}, doc_title string, heading string, text string, position int, start_line int, end_line int")


def contextualised(chunk_rows: DataFrame) -> DataFrame:
    """chunks with `contextualised`: breadcrumb, heading, the first sentence of the chunk before, and the text."""
    before = first_sentence(F.lag("text").over(W.partitionBy("doc_id").orderBy("position")))
    led = F.when(before != "", F.when(F.endswith(before, F.lit(".")), before).otherwise(F.concat(before, F.lit(".")))).when(before.isNotNull(), "")
    crumb = F.when(F.col("heading") != "", F.concat(F.lit("["), "doc_title", F.lit(" > "), "heading", F.lit("]"))).otherwise(F.concat(F.lit("["), "doc_title", F.lit("]")))
    return chunk_rows.withColumn("contextualised", F.concat_ws(" ", crumb, F.when(F.col("heading") != "", F.col("heading")), led, F.col("text")))


def breadcrumb(context: Column, text: Column) -> Column:
    """A chunk's scopes above its text."""
    return F.when(F.coalesce(context, F.lit("")) != "", strip(F.concat(context, F.lit("\n"), text))).otherwise(text)


def enriched(context: Column, text: Column) -> Column:
    """A text led by what a contextualizer says of it."""
    return strip(F.concat(F.coalesce(context, F.lit("")), F.lit(" "), text))
