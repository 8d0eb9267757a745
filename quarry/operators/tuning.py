"""Corpus signals and the parameters they decide: one row of aggregates, then CASE expressions over it."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import cjk_count, suffix, tokens, word_count
from quarry.operators.chunking import LANGUAGES, ChunkingPolicy

MINILM, MPNET, CODESEARCH = "sentence-transformers/all-MiniLM-L6-v2", "sentence-transformers/all-mpnet-base-v2", "flax-sentence-embeddings/st-codesearch-distilroberta-base"
DIMENSIONS = {MINILM: 384, MPNET: 768, CODESEARCH: 768}
THIN_P10 = 15


def extension_histogram(files: DataFrame) -> DataFrame:
    """(ext, n) of files(path)."""
    return files.groupBy(suffix(F.col("path")).alias("ext")).agg(F.count(F.lit(1)).alias("n"))


def file_signals(files: DataFrame) -> DataFrame:
    """(n_files, total_bytes, code_bytes, code_fraction, median_code_lines), one row, of files(path, size, text)."""
    code = suffix(F.col("path")).isin(*LANGUAGES)
    n_lines = F.regexp_count("text", F.lit("\n")) + 1
    out = files.agg(
        F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes"), F.coalesce(F.sum(F.when(code, F.col("size"))), F.lit(0)).cast("long").alias("code_bytes"),
        F.percentile(F.when(code & F.col("text").isNotNull(), n_lines), 0.5).alias("median_code_lines"),
    )
    return out.withColumn("code_fraction", F.when(F.col("total_bytes") > 0, F.col("code_bytes") / F.col("total_bytes")).otherwise(0.0))


def chunk_signals(chunks: DataFrame, mode: str = "plain") -> DataFrame:
    """Number and token lengths of chunks(text), one row; the statistics are null without chunks. Percentiles are exact."""
    n = F.size(tokens(F.col("text"), mode))
    sized = chunks.select(n.alias("n"), cjk_count(F.col("text")).alias("cjk"), word_count(F.col("text")).alias("words"))
    mean = F.avg("n")
    return sized.agg(
        F.count(F.lit(1)).alias("n_chunks"), mean.alias("mean_chunk_tokens"), F.when(mean > 0, F.stddev_pop("n") / mean).when(mean.isNotNull(), 0.0).alias("chunk_token_cv"),
        *(F.percentile("n", p / 100).alias(f"p{p}_chunk_tokens") for p in (10, 50, 90)), F.when(F.sum("words") > 0, F.sum("cjk") / F.sum("words")).otherwise(0.0).alias("cjk_fraction"),
    )


def decisions(signals: DataFrame) -> DataFrame:
    """signals with the parameters decided from code_fraction, median_code_lines, n_chunks, chunk_token_cv,
    p50_chunk_tokens, p90_chunk_tokens and cjk_fraction; nulls stand for a corpus without files or chunks."""
    code, cv, p50, n = (F.col(c) for c in ("code_fraction", "chunk_token_cv", "p50_chunk_tokens", "n_chunks"))
    spread = F.when(p50 > 0, F.coalesce("p90_chunk_tokens", F.lit(0.0)) / p50)
    model = F.when(n.isNull(), MINILM).when(code > 0.6, CODESEARCH).when(n <= 2000, MPNET).otherwise(MINILM)
    dims = F.element_at(F.create_map(*[F.lit(x) for pair in DIMENSIONS.items() for x in pair]), F.col("model_name"))
    long_ = F.coalesce(p50 > 2000, F.lit(False))
    out = signals.withColumns({
        "prose_chars": F.lit(400), "config_chars": F.lit(700), "code_chars": F.when(code > 0.3, 1200).otherwise(400), "default_chars": F.lit(400),
        "ast_max_chars": F.when(F.col("median_code_lines") > 400, 2000).otherwise(1200),
        "tokenizer": F.when(F.col("cjk_fraction") >= 0.1, "cjk").when(code > 0.3, "code").otherwise("plain"),
        "bm25_k1": F.when(code > 0.6, 1.2).when(code >= 0.2, 1.5).when(p50 > 150, 1.8).otherwise(1.5),
        "bm25_b": F.when(cv.isNull(), 0.75).when((cv > 1.2) | F.coalesce(spread > 4, F.lit(False)), 1.0).when(cv >= 0.4, 0.75).otherwise(0.3),
        "model_name": model, "lucene_k1": F.when(long_, 25.0).otherwise(0.9), "lucene_b": F.when(long_, 1.0).otherwise(0.4),
    })
    total = n * F.coalesce(dims, F.lit(384))
    return out.withColumn("bit_width", F.when(F.coalesce(n, F.lit(0)) == 0, 4).when(total <= 5e7, 4).when(total <= 5e8, 3).otherwise(2))


def top_k(mean_tokens: Column) -> Column:
    """How many hits about 1500 tokens are, half to even, from 5 to 30; 5 where the mean is unknown or zero."""
    wanted = F.bround(F.lit(1500.0) / mean_tokens, 0)
    return F.when(F.coalesce(mean_tokens, F.lit(0.0)) == 0, 5).otherwise(F.greatest(F.lit(5), F.least(F.lit(30), wanted))).cast("int")


def thin_warning(p10: float | None) -> str | None:
    """A remark if the shortest tenth of chunks has few tokens."""
    return None if p10 is None or p10 >= THIN_P10 else f"a tenth of the chunks have {p10:.1f} tokens or fewer; under {THIN_P10}, chunks may say too little to be ranked by their words"


PARAMETERS = ("prose_chars", "config_chars", "code_chars", "default_chars", "ast_max_chars", "tokenizer", "bm25_k1", "bm25_b", "model_name", "bit_width", "lucene_k1", "lucene_b")


def resolve(signals: DataFrame, overrides: dict[str, Any] | None = None) -> dict[str, Any]:
    """The parameters for a corpus: what is given wins over what is decided. A given model decides the bit width too."""
    given = {k: v for k, v in (overrides or {}).items() if v is not None}
    row = decisions(signals).select(*PARAMETERS, "n_chunks").first().asDict()
    n = row.pop("n_chunks")
    if "model_name" in given and n:
        total = n * DIMENSIONS.get(given["model_name"], 384)
        row["bit_width"] = 4 if total <= 5e7 else 3 if total <= 5e8 else 2
    return row | given


def policy(parameters: dict[str, Any]) -> ChunkingPolicy:
    return ChunkingPolicy.from_dict(parameters)
