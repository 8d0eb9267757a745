"""Document quality by hierarchical empirical Bayes.

A classifier on a text's surface (bounded sample of labelled rows) gives each document its evidence. All documents, by
label where there is one and by the classifier elsewhere, make the record of their path and host. Records are shrunk: a
path's towards its host's, a host's towards the whole table's, by as much as sites of that level vary beyond chance. A
document's posterior adds its evidence to what its site, without the document itself, says.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import written

#: Labelled rows that the classifier is fitted on, at most: those of least hash, rows that are alike counted as often as they are.
FIT_ROWS = 20_000
#: The hash range is parted by so many bits, and the part that holds the sample's end again.
PARTED = 12
#: Probabilities are summed as whole numbers of this part, so that no order of summing shows.
UNIT = 1_000_000
FEATURES = ("log_bytes", "log_words", "word_length", "distinct_words", "distinct_lines", "upper", "digit", "bang", "bar", "stop", "comma", "markup", "other", "wide")


def _classes() -> np.ndarray:
    """For each byte, its column among the last of FEATURES, or -1."""
    out = np.full(256, -1)
    for name, chars in (("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", b"0123456789"), ("bang", b"!?"), ("bar", b"|"), ("stop", b"."), ("comma", b",;:"), ("markup", b"<>{}[]/\\=&#@%"), ("other", b"\"'()*+-_`~^$"), ("wide", bytes(range(128, 256)))):
        out[list(chars)] = FEATURES.index(name)
    return out


_CLASS = _classes()


def surface(text: bytes) -> np.ndarray:
    """The features of a whole text; an empty one is all zero."""
    out = np.zeros(len(FEATURES))
    words, lines = text.split(), text.split(b"\n")
    if words:
        counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        out += np.bincount(_CLASS[_CLASS >= 0], weights=counts[_CLASS >= 0], minlength=len(FEATURES)) / len(text)
        out[:5] = np.log1p(len(text)), np.log1p(len(words)), len(text) / len(words), len(set(words)) / len(words), len(set(lines)) / len(lines)
    return out


def features(docs: DataFrame, host: str, path: str) -> DataFrame:
    """(doc_id, host, path, x): a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [surface(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(x, pa.list_(pa.float64()))], ["doc_id", "host", "path", "x"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col("text").cast("string").cast("binary").alias("text"))
    return own.mapInArrow(run, "doc_id long, host string, path string, x array<double>")


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """(weights, intercept) of a ridge logistic regression on x as it is; with one class or no rows, its rate alone."""
    rate = (y.sum() + 1) / (len(y) + 2)
    if len(np.unique(y)) < 2:
        return np.zeros(len(FEATURES)), float(np.log(rate / (1 - rate)))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * (z.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def _strength(sites: DataFrame, parent: str) -> float:
    """How many documents' worth of the parent's rate a site's own record is mixed with (by moments)."""
    r = F.col("s") / F.col("n")
    row = sites.where("n > 0").agg(F.sum(F.col("n") * (r - F.col(parent)) ** 2).alias("v"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("sites"), F.sum(F.col(parent) * (1 - F.col(parent))).alias("noise"), F.sum(F.col("n") * F.col(parent) * (1 - F.col(parent))).alias("spread")).first()
    if not row["n"]:
        return 1.0
    between = (row["v"] - row["noise"]) / row["n"]
    spread = row["spread"] / row["n"]
    return float(np.clip(np.round(spread / between - 1, 6), 1.0, 1e6)) if between > 1e-9 else 1e6


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def fit_sample(labelled: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, label) of the `rows` rows of least hash, or all, of labelled(doc_id, x, label).

    Rows are counted by parts of the hash range, until the part where the sample ends holds few; then all rows up to its
    end are fetched, those that are alike as one with their number. At most 2 * rows and a part's worth come to the driver."""
    placed = labelled.withColumn("place", F.shiftrightunsigned(F.xxhash64("doc_id", "x", "label"), 1))
    low, high, before = 0, (1 << 63) - 1, 0
    for bits in range(63 - PARTED, PARTED, -PARTED):
        offset = F.col("place") - F.lit(low)
        inside = placed.where(F.shiftrightunsigned(offset, bits + PARTED) == 0)
        last = None
        for part, n in sorted(map(tuple, inside.groupBy(F.shiftright(offset, bits)).count().collect())):
            if before + n > rows:
                low, high, last = low + (part << bits), low + (part + 1 << bits) - 1, n
                break
            before += n
        if last is None or last <= rows:
            break
    alike = placed.where(F.col("place") <= F.lit(high)).groupBy("place", "doc_id", "label", "x").agg(F.count(F.lit(1)).alias("n")).toPandas()
    alike["x"] = alike["x"].map(tuple)
    alike = alike.sort_values(["place", "doc_id", "label", "x"])
    n = np.diff(np.minimum(np.cumsum(np.r_[0, alike["n"]]), rows))
    x = np.array(alike["x"].tolist()).reshape(len(alike), len(FEATURES))
    return np.repeat(x, n, axis=0), np.repeat(alike["label"].to_numpy(float), n)


def rate(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """A row for each row of docs(doc_id, text, host, path, ...): doc_id, p_doc, p_site, quality, keep.

    labels(doc_id, quality): rows with nulls are left out; of several for a document the highest counts. Null hosts and
    paths are sites of their own; a null text is an empty one. Without labels each document gets its site's prior of one
    half. An empty table gives no rows; other columns are not read. Repeated rows count, and come, as often as they are.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("double")).alias("label"))
    rows = written(features(docs, host, path).join(known, "doc_id", "left").select("doc_id", "host", "path", "x", "label"), "features")
    x, y = fit_sample(rows.where(F.col("label").isNotNull()).select("doc_id", "x", "label"), fit_rows)
    w, intercept = fit(x, y)
    base = (float(y.sum()) + 1) / (len(y) + 2)
    dot = sum((F.col("x")[i] * float(v) for i, v in enumerate(w)), F.lit(intercept))
    p_doc = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), dot))))
    scored = rows.withColumn("p_doc", p_doc).withColumn("q", F.round(F.coalesce("label", "p_doc") * UNIT).cast("long"))
    by_path = written(scored.groupBy("host", "path").agg((F.sum("q") / F.lit(UNIT)).alias("s"), F.count(F.lit(1)).alias("n"), F.sum("q").alias("whole")), "sites")
    total = by_path.agg(F.sum("whole").alias("s"), F.sum("n").alias("n")).first()
    mean = total["s"] / UNIT / total["n"] if total["n"] else 0.5
    by_host = by_path.groupBy("host").agg((F.sum("whole") / F.lit(UNIT)).alias("s"), F.sum("n").alias("n")).withColumn("mean", F.lit(float(mean)))
    m = _strength(by_host, "mean")
    hosts = by_host.select(F.col("host").alias("of"), ((F.col("s") + m * F.col("mean")) / (F.col("n") + m)).alias("host_rate"))
    paths = by_path.join(hosts, by_path["host"].eqNullSafe(hosts["of"])).drop("of")
    m = _strength(paths, "host_rate")
    sites = paths.select(F.col("host").alias("h"), F.col("path").alias("p"), "s", "n", "host_rate")
    joined = scored.join(sites, scored["host"].eqNullSafe(sites["h"]) & scored["path"].eqNullSafe(sites["p"]))
    # what the site says without this document
    p_site = (F.col("s") - F.col("q") / F.lit(UNIT) + m * F.col("host_rate")) / (F.col("n") - 1 + m)
    found = joined.withColumn("p_site", F.greatest(F.lit(0.0), F.least(F.lit(1.0), p_site)))
    logit = _logit(F.col("p_site")) + _logit(F.col("p_doc")) - float(np.log(base / (1 - base)))
    return found.withColumn("quality", 1 / (1 + F.exp(-logit))).select("doc_id", "p_doc", "p_site", "quality", (F.col("quality") >= threshold).alias("keep"))
