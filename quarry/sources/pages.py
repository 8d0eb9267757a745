"""Text of paged files: running heads and feet go, lines are put together into paragraphs, pages become sections.

Which lines run is counted over all pages of a file by two groupings; a page's own lines are one array.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import lines, strip, unwrapped

#: Pages from which running lines are looked for, and the part of the pages that one has to be on more of.
LEAST_PAGES, SHARE = 5, 0.6
#: Part of the median line under which a line ends its paragraph; characters of the shortest paragraph.
SHORT, LEAST_CHARS = 0.6, 3
#: A file has no text layer if more than SPARSE of its pages have fewer characters than PAGE_CHARS.
PAGE_CHARS, SPARSE = 100, 0.3


def running_lines(pages: DataFrame, share: float = SHARE, least: int = LEAST_PAGES) -> DataFrame:
    """(doc, place, line): lines that are the first (or last) one not blank on more than a share of pages(doc, text)."""
    bare = F.filter(F.transform(lines(F.col("text")), strip), lambda x: x != "")
    ends = pages.select("doc", bare.alias("bare")).where(F.size("bare") > 0)
    both = F.array(F.struct(F.lit("head").alias("place"), F.get("bare", F.lit(0)).alias("line")), F.struct(F.lit("foot").alias("place"), F.element_at("bare", -1).alias("line")))
    counts = ends.select("doc", F.explode(both).alias("x")).groupBy("doc", "x.place", "x.line").agg(F.count(F.lit(1)).alias("on"))
    whole = pages.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return counts.join(whole, "doc").where(F.col("on") > share * F.col("n")).select("doc", "place", "line")


def reflowed(page: list[str]) -> list[str]:
    """Paragraphs of a page's lines: one ends at a blank line, or after a line much shorter than the others."""
    bare = [x.strip() for x in page]
    body = [len(x) for x in bare[:-1] if x] or [0]
    short, held, out = SHORT * median(body), [], []
    for x in bare:
        if x:
            held.append(x)
        if held and (not x or len(x) < short):
            out.append(" ".join(held))
            held = []
    out += [" ".join(held)] if held else []
    return [x for x in out if len(x) >= LEAST_CHARS]


def page_texts(pages: DataFrame) -> DataFrame:
    """(doc, page, text) of pages(doc, page, text), without running lines, reflowed; null texts are empty pages."""
    clean = pages.select("doc", "page", F.coalesce(unwrapped(F.col("text")), F.lit("")).alias("text"))
    running = running_lines(clean).groupBy("doc").agg(F.collect_set(F.when(F.col("place") == "head", F.col("line"))).alias("heads"), F.collect_set(F.when(F.col("place") == "foot", F.col("line"))).alias("feet"))
    kind, number = (pages.schema[c].dataType.simpleString() for c in ("doc", "page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, heads, feet in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                page = text.splitlines()
                for at, gone in ((0, heads or ()), (-1, feet or ())):
                    full = [i for i, x in enumerate(page) if x.strip()]
                    if full and page[full[at]].strip() in gone:
                        page[full[at]] = ""
                out.append("\n\n".join(reflowed(page)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["doc", "page", "text"])

    return clean.join(running, "doc", "left").select("doc", "page", "text", "heads", "feet").mapInArrow(run, f"doc {kind}, page {number}, text string")


def transcripts(pages: DataFrame) -> DataFrame:
    """(doc, text, status, reason, pages): a file's pages under their numbers, in order.

    A file whose pages have no text is the stub `empty`; one where too many have little, `no-text-layer`."""
    found = page_texts(pages).groupBy("doc").agg(
        F.array_sort(F.collect_list(F.struct("page", "text"))).alias("x"), F.count(F.lit(1)).cast("int").alias("pages"),
        F.avg((F.length("text") < PAGE_CHARS).cast("double")).alias("sparse"), F.max(F.length("text")).alias("longest"),
    )
    body = F.array_join(F.transform("x", lambda p: F.concat(F.lit("## Page "), p["page"].cast("string"), F.lit("\n\n"), p["text"])), "\n\n")
    reason = F.when(F.col("longest") == 0, "empty").when(F.col("sparse") > SPARSE, "no-text-layer").otherwise("")
    return found.select("doc", F.when(reason == "", body).otherwise("").alias("text"), F.when(reason == "", "ok").otherwise("stub").alias("status"), reason.alias("reason"), "pages")
