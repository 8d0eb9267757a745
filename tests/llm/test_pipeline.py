"""The corpus pipeline, stage by stage and as a whole, against plain Python."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_similar import brute
from test_training_operators import brute_mix, sentence

import corpus_pipeline
from quarry.llm import language
from quarry.llm.vocabulary import default_path, encoded

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
OWN = {"xx": "ka lo mi ren tas", "yy": "sch ung ber ich keit"}


def table() -> list[tuple]:
    rng = random.Random(21)
    texts = [(sentence(rng, rng.randint(5, 120), OWN[lang]), lang) for lang in ("xx", "yy") * 25]
    texts += [(texts[4][0], "xx"), (texts[4][0].replace(" ", "\n "), None), (texts[5][0] + " more", "yy"), (texts[7][0] + " x y", None), (None, "xx"), ("", "yy"), ("12 34 !!", "xx"), ("kalomi schung", None), (sentence(rng, 2500, OWN["xx"]), "xx")]
    rows = [(2 * i, t, lang, ("a", "b", None, "hot", "hot", "hot")[i % 6], None if t is None else len(t)) for i, (t, lang) in enumerate(texts)]
    return [*rows, rows[8], rows[8], (None, sentence(rng, 30, OWN["yy"]), "yy", "a", 5)]


def accepted(spark, rows: list[tuple]) -> list[tuple]:
    """Scores by logarithms over all segmentations, with the model that the operator learns."""
    langs, p = language.fit(spark.createDataFrame(rows, SCHEMA))
    vocabulary = language.pieces(default_path("piece_bpe_32k.model"))
    index, out = {n: i for i, n in enumerate(vocabulary.names)}, []
    for row in rows:
        total = np.zeros(len(langs))
        words = re.findall(r"[^\W\d_]+", (row[1] or "").lower())
        for w in ("▁" + x for x in words):
            a = [np.zeros(len(langs))]
            for i in range(1, len(w) + 1):
                terms = [a[i - k] + np.log(p[j]) for k in range(1, i + 1) if (j := index.get(w[i - k : i], vocabulary.other if k == 1 else None)) is not None]
                a.append(np.logaddexp.reduce(terms, axis=0))
            total += a[-1]
        if words and 1 / np.exp(total - total.max()).sum() >= 0.5:
            out.append(row)
    return out


def first_by_id(rows: list[tuple], group: list) -> list[tuple]:
    best: dict = {}
    for row, g in zip(rows, group, strict=True):
        if g not in best or (row[0] is None, row[0] or 0) < (best[g][0] is None, best[g][0] or 0):
            best[g] = row
    return list(best.values())


def mixed(rows: list[tuple]) -> list[tuple]:
    taken, out = {i: t for i, *_, t in brute_mix(rows)}, []
    for i, text, lang, source, n in rows:
        words = text.split()
        out += [(i, text, lang, source, n)] * (taken[i] // len(words))
        if part := " ".join(words[: taken[i] % len(words)]):
            out.append((i, part, lang, source, len(part)))
    return out


def pieces(rows: list[tuple]) -> Counter:
    out = Counter()
    for i, text, *_ in rows:
        ids = np.array([*encoded(text, default_path()), 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            out[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    return out


def test_stages_and_run(spark, tmp_path):
    rows = table()
    docs = lambda rows: spark.createDataFrame(rows, SCHEMA).repartition(4)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    wanted = [
        accepted(spark, rows),
    ]
    wanted.append(first_by_id(wanted[0], [re.sub("[\x20\x09-\x0d]+", " ", r[1]) for r in wanted[0]]))
    wanted.append(first_by_id(wanted[1], brute([r[1] for r in wanted[1]])))
    wanted.append(mixed(wanted[2]))
    assert len(rows) > len(wanted[0]) > len(wanted[1]) > len(wanted[2]) > 40
    given = rows
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], wanted, strict=True):
        got = stage(spark, docs(given), str(tmp_path))
        assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")], name
        assert Counter(map(tuple, got.collect())) == Counter(want), name
        given = want
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(tuple(r)[:5] for r in found) == pieces(wanted[3])
    filled = Counter()
    for r in found:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 1024 and len(filled) <= math.ceil(sum(filled.values()) / 1024) + 1


def test_run_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", ["language_id", "exact_dedup", "near_dedup", "mixing"])
def test_stages_refuse_reserved_names(spark, name):
    given = spark.createDataFrame([(1, "some words", "xx", "a", 10, 1)], SCHEMA + ", __q_id long")
    with pytest.raises(ValueError, match="__q_"):
        dict(corpus_pipeline.STAGES)[name](spark, given, "").collect()
