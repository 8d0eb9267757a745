"""Transcripts of files that hold no plain text: their manifest, its states, what is to be extracted, registration."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import basename, strip, suffix
from quarry.sources import extractors
from quarry.sources.captions import decoded, transcripts
from quarry.sources.files import AGENT_READ, TOOL_READ

VERSIONS = {".srt": "captions/1", ".vtt": "captions/1"}
AGENT_VERSION, PDF_VERSION = "agent-authored/1", "pdf-text/1"
MAX_CHARS = 1_000_000
MARKER = "\n\n_[transcript truncated: exceeded extraction size budget]_"
UNIT = r"(?m)^## (?:Page \d+|\[\d{2}:\d{2}:\d{2}\][^\n]*)\s*$"
HEADER = re.compile(r"\A(?:<!--[^\n]*-->\n)+")
UNIT_START = re.compile(r"^(?=## (?:Page [0-9]+\s*$|\[[0-9]{2}:[0-9]{2}:[0-9]{2}\]))", re.MULTILINE)
ENTRY = "rel string, sha256 string, source_bytes long, identity string, extractor_version string, sidecar string, sidecar_bytes long, pages int, status string, reason string, truncated boolean, authored_by string, authored_at string, sidecar_sha256 string"


def version(path: Column, readers: extractors.Registry = extractors.REGISTRY) -> Column:
    out = F.lit(PDF_VERSION)
    for end, name in (VERSIONS | readers.versions()).items():
        out = F.when(suffix(path) == end, name).otherwise(out)
    return out


def identity(path: Column, size: Column, mtime_ns: Column, content: Column) -> Column:
    """What a source is known by: the hash of its bytes, or of its size and time where its bytes are never read."""
    return F.when(suffix(path).isin(*TOOL_READ), F.sha2(F.concat_ws("|", F.lit("stat/1"), size.cast("string"), mtime_ns.cast("string")), 256)).otherwise(F.sha2(content, 256))


def states(sources: DataFrame, manifest: DataFrame) -> DataFrame:
    """(rel, state) of sources(rel, sha256): missing, outdated, agent-authored, stub or ok, the first that holds."""
    known = manifest.select("rel", F.col("sha256").alias("__sha"), "authored_by", "status", F.lit(True).alias("__known"))
    state = F.when(F.col("__known").isNull(), "missing").when(~F.col("sha256").eqNullSafe(F.col("__sha")), "outdated").when(F.col("authored_by") == "agent", "agent-authored").when(F.col("status") == "stub", "stub").otherwise("ok")
    return sources.join(known, "rel", "left").select("rel", state.alias("state"))


def to_extract(sources: DataFrame, manifest: DataFrame, readers: extractors.Registry = extractors.REGISTRY, force: bool = False) -> DataFrame:
    """The sources whose manifest entry is no hit: absent, of other bytes or an unknown version, without transcript, or a
    stub for want of a reader that is there now."""
    if force:
        return sources
    versions = {*VERSIONS.values(), *readers.versions().values(), AGENT_VERSION, PDF_VERSION}
    missed = (F.coalesce("reason", F.lit("")) == "backend-missing") & suffix(F.col("rel")).isin(*readers.suffixes()) if readers.suffixes() else F.lit(False)
    hit = manifest.where(F.col("extractor_version").isin(*versions) & (F.coalesce("status", F.lit("")) != "") & (F.coalesce("sidecar", F.lit("")) != "") & ~missed)
    return sources.join(hit.select("rel", "sha256"), ["rel", "sha256"], "left_anti")


def pruned(manifest: DataFrame, keep: DataFrame) -> DataFrame:
    """The entries whose source is still there."""
    return manifest.join(keep.select("rel"), "rel", "left_semi")


def revision(authored_by: Column, sidecar_sha256: Column) -> Column:
    """What an agent's transcript adds to the fingerprint of its source."""
    return F.when(authored_by == "agent", F.coalesce(sidecar_sha256, F.lit(""))).otherwise("")


def rendered(rel: Column, text: Column, status: Column, reason: Column, made_by: Column) -> Column:
    """A transcript as Markdown with its header; a stub says which file it stands for."""
    head = F.concat(F.lit("<!-- source: "), rel, F.lit(" -->\n<!-- extractor: "), made_by, F.lit(" status: "), status, F.lit(" reason: "), reason, F.lit(" -->\n"))
    stub = F.concat(F.lit("\n# "), basename(rel), F.lit("\n\n"), F.when(text != "", text).otherwise("No text could be read from this file."), F.lit("\n"))
    return F.concat(head, F.when(status == "ok", F.concat(F.lit("\n"), text)).otherwise(stub))


def cut_at_unit(text: str, limit: int) -> str:
    """A text over the limit, cut before the first unit that passes it, or anywhere without units; one linear pass."""
    bare = HEADER.sub("", text)
    if len(bare) <= limit:
        return bare
    units = [u.rstrip("\n") for u in UNIT_START.split(bare) if UNIT_START.match(u)]
    if not units:
        return bare[: max(0, limit - len(MARKER))] + MARKER
    kept, size = [], 0
    for u in units:
        more = len(u) + (2 if kept else 0)
        if kept and size + more + len(MARKER) > limit:
            break
        kept.append(u)
        size += more
    return "\n\n".join(kept) + MARKER


def truncated_at_unit(text: Column, limit: int = MAX_CHARS) -> Column:
    """A text over the limit, cut before the first unit (page, timed section) that passes it, or anywhere without units."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else cut_at_unit(x, limit) for x in texts.to_pylist()], pa.string())

    return cut(text)


def registered(transcripts_: DataFrame) -> DataFrame:
    """Manifest rows and texts of transcripts(rel, sha256, source_bytes, transcript) that an agent wrote; blank ones go."""
    text = truncated_at_unit(F.col("transcript"))
    made = transcripts_.where(strip(F.col("transcript")) != "").withColumn("text", text).withColumn("sidecar_text", rendered(F.col("rel"), F.col("text"), F.lit("ok"), F.lit(""), F.lit(AGENT_VERSION)))
    return made.select("rel", "sha256", "source_bytes", F.lit(AGENT_VERSION).alias("extractor_version"), F.regexp_count("transcript", F.lit(UNIT)).alias("pages"), F.lit("ok").alias("status"), F.lit("").alias("reason"), (F.length("transcript") > MAX_CHARS).alias("truncated"), F.lit("agent").alias("authored_by"), F.sha2("sidecar_text", 256).alias("sidecar_sha256"), "sidecar_text")


def extracted(sources: DataFrame, readers: extractors.Registry = extractors.REGISTRY) -> DataFrame:
    """(rel, text, status, reason, pages) of sources(rel, content): captions are transcribed, files that a reader is
    registered for become their pages, all others are stubs that say how they may be read."""
    end = suffix(F.col("rel"))
    read = end.isin(*readers.suffixes()) if readers.suffixes() else F.lit(False)
    timed = transcripts(sources.where(end.isin(".srt", ".vtt") & ~read).select(F.col("rel").alias("path"), decoded(F.col("content")).alias("text"))).withColumnRenamed("path", "rel")
    reason = F.when(end.isin(*TOOL_READ), "agent-orchestrated").when(end.isin(*AGENT_READ), "agent-only").otherwise("backend-missing")
    said = F.when(end.isin(*TOOL_READ), "Audio or video: a speech recogniser has to be run and its transcript registered.").when(end.isin(*AGENT_READ), "An agent has to read this file and register a transcript.").otherwise("The backend for this format is not installed.")
    stubs = sources.where(~end.isin(".srt", ".vtt") & ~read).select("rel", said.alias("text"), F.lit("stub").alias("status"), reason.alias("reason"), F.lit(0).alias("pages"))
    return timed.unionByName(stubs).unionByName(readers.transcripts(sources))
