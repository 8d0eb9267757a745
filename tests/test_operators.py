"""Operators against plain Python on random small cases, and their edges."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking, consolidation, dense, evaluation, lexical, scoring, syntax, tuning


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


# -- lexical


def brute_lexical(texts: list[str], query: str, k1: float = 1.5, b: float = 0.75) -> list[tuple[int, float]]:
    """All documents, both arms zero-filled, fused."""
    docs, n = [Counter(t.lower().split()) for t in texts], len(texts)
    df = Counter(w for d in docs for w in d)
    dl = [sum(d.values()) for d in docs]
    avg = sum(dl) / n or 1.0
    q = Counter(query.lower().split())
    qn = math.sqrt(sum((1 + math.log(c)) ** 2 for c in q.values()))
    bm, ti = [], []
    for d, size in zip(docs, dl, strict=True):
        bm.append(round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * d[w] * (k1 + 1) / (d[w] + k1 * (1 - b + b * size / avg)) for w in q if d[w]), 9))
        raw = {w: (1 + math.log(c)) * (math.log((n + 1) / (df[w] + 1)) + 1) for w, c in d.items()}
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1.0
        ti.append(round(sum((1 + math.log(c)) / qn * raw[w] / norm for w, c in q.items() if w in raw), 9))
    place = [{i: r for r, i in enumerate(sorted(range(n), key=lambda i: (-s[i], i)))} for s in (ti, bm)]
    score = [1 / (61 + place[0][i]) + 1 / (61 + place[1][i]) for i in range(n)]
    return [(i, score[i]) for i in sorted(range(n), key=lambda i: (-round(score[i], 12), place[0][i]))]


def test_lexical_search_is_that_of_all_documents(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 9))) for _ in range(25)]
    queries = [(i, " ".join(rng.choice("abcdefghijxyz") for _ in range(rng.randint(0, 4)))) for i in range(12)]
    index = lexical.LexicalIndex.of(spark.createDataFrame(list(enumerate(texts)), "doc_idx long, text string").withColumn("docid", F.col("doc_idx").cast("string")))
    asked = spark.createDataFrame(queries, "query_id int, query string")
    for k in (3, 25, 40):
        got = defaultdict(list)
        for r in lexical.lexical_search(index, asked, k).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.doc_idx, round(r.score, 9)))
        for i, q in queries:
            assert got[i] == [(d, round(s, 9)) for d, s in brute_lexical(texts, q)][:k], (k, q)


def test_lexical_edges(spark):
    schema = "doc_idx long, docid string, text string"
    asked = spark.createDataFrame([(1, "word"), (2, ""), (3, None)], "query_id int, query string")
    empty = lexical.LexicalIndex.of(spark.createDataFrame([], schema))
    assert (empty.n_docs, empty.avgdl) == (0, 1.0) and lexical.lexical_search(empty, asked, 5).count() == 0
    blank = lexical.LexicalIndex.of(spark.createDataFrame([(0, "a", None), (1, "b", ""), (2, "c", "word")], schema))
    assert blank.n_docs == 3 and blank.avgdl == pytest.approx(1 / 3)
    got = [(r.query_id, r.doc_idx) for r in lexical.lexical_search(blank, asked, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 2), (1, 0), (2, 0), (2, 1), (3, 0), (3, 1)]
    assert lexical.bm25_scores(LexicalNoWeights(blank), asked).count() == 1


def LexicalNoWeights(index):
    return lexical.LexicalIndex(index.docs, index.postings.select("term", "doc_idx", "tf", "dl"), index.n_docs, index.avgdl)


def test_rank_fusion(spark):
    rows = [(1, "a", 0, 10, 0), (1, "a", 0, 11, 1), (1, "b", 1, 12, 0), (1, "b", 1, 10, 1)]
    df = spark.createDataFrame(rows, "query_id int, arm string, arm_no int, doc_idx long, rank int")
    got = [(r.doc_idx, round(r.score, 12)) for r in lexical.reciprocal_rank_fusion(df).orderBy("rank").collect()]
    assert got == [(10, round(1 / 61 + 1 / 62, 12)), (12, round(1 / 61, 12)), (11, round(1 / 62, 12))]
    heavy = lexical.reciprocal_rank_fusion(df.orderBy(F.rand(3)), weights={"b": 3.0}).orderBy("rank").collect()
    assert [r.doc_idx for r in heavy] == [10, 12, 11] and heavy[0].score == pytest.approx(1 / 61 + 3 / 62)


def test_candidate_pool():
    assert [lexical.candidate_pool(k) for k in (1, 5, 7)] == [50, 50, 70] and lexical.candidate_pool(7, 30) == 30


# -- text


def test_tokens(spark):
    assert one(spark, "Naïve x² é под_1 -", T.tokens) == ["naïve", "x²", "e", "под_1"]
    assert one(spark, None, T.tokens) == [] and one(spark, "parseHTTPResponse", lambda c: T.tokens(c, "code")) == ["parsehttpresponse", "parse", "http", "response"]
    with pytest.raises(ValueError):
        T.tokens(F.lit("x"), "other")


@pytest.mark.parametrize("x", ["", "a", "a\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i j k", "\n\n", "a\n\nb\n"])
def test_lines(spark, x):
    assert one(spark, x, T.lines) == x.splitlines()


def test_strip_and_paths(spark):
    assert one(spark, "  a b \x1f\n", T.strip) == "a b"
    assert [one(spark, p, T.suffix) for p in ("a/b.PY", ".json", "x.tar.gz", "none")] == [".py", "", ".gz", ""]
    assert one(spark, "é" * 10, lambda c: T.capped(c, 5)) == "éé" and one(spark, "abc", lambda c: T.capped(c, 5)) == "abc"
    assert one(spark, "01:02:03,500", T.seconds) == 3723.5 and one(spark, 3723.9, T.clock, "double") == "01:02:03"


def test_first_sentence(spark):
    assert one(spark, "One two! Three.", T.first_sentence) == "One two!" and len(one(spark, "x" * 300, T.first_sentence)) == 120


# -- chunks


def test_chunk_rules():
    paras = "A\n\n" + "b" * 30 + "\n\n" + "c" * 30 + "\n\nHead:\n" + "d" * 500 + "\n\nHead:\nsame\n\n## Empty\n"
    got = chunking.chunks_of(paras, 40)
    assert [(h, len(t), a, b) for h, t, a, b in got] == [("", 32, 1, 3), ("", 30, 5, 5), ("Head", 500, 7, 8), ("Head", 4, 11, 11)]
    assert chunking.chunks_of("# Only\n## More\n", 40) == [("", "# Only\n## More", 1, 2)]
    assert chunking.chunks_of(" \n\t", 40) == [] and chunking.chunks_of("x\r\ny", 40) == [("", "x y", 1, 2)]
    assert chunking.chunks_of("﻿Title\nmore", 40)[0][1] == "﻿Title more"


def test_chunks_of_a_table(spark):
    docs = spark.createDataFrame([("d", "T\n\nPart One:\nx"), ("e", None), ("f", " "), ("g", "#bad\nz")], "doc_id string, text string")
    got = {(r.id, r.doc_title, r.heading, r.text, r.start_line, r.end_line) for r in chunking.chunks(docs).collect()}
    assert got == {("d_0", "T", "", "T", 1, 1), ("d_1", "T", "Part One", "x", 3, 4), ("g_0", "#bad", "", "#bad z", 1, 2)}


def test_folds_take_few_texts_at_once():
    texts = ["a" * chunking.BYTES, None, "b", "", "c" * (chunking.BYTES + 1), "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["doc_id", "text"])
    assert [x.column(0).to_pylist() for x in chunking.few([batch])] == [[0, 1], [2, 3], [4], [5]]


def test_context_of_the_chunk_before(spark):
    rows = [("d", "T", "", "First one! Second.", 0), ("d", "T", "H", "Next", 1), ("d", "T", "", "Last.", 2)]
    got = [r.contextualised for r in chunking.contextualised(spark.createDataFrame(rows, "doc_id string, doc_title string, heading string, text string, position int")).orderBy("position").collect()]
    assert got == ["[T] First one! Second.", "[T > H] H First one!. Next", "[T] Next. Last."]


SOURCE = '''import os
import re

class Big:
    """Doc."""
    size = 1

    def first(self):
        return [x for x in range(1000) if x % 7 == 0 and x % 11 == 3]

    def second(self):
        return {x: x * x for x in range(1000) if x % 5 == 0}

def tail():
    return 1
'''


def test_syntax_chunks():
    got = syntax.chunks_of(SOURCE, 70, syntax.python_tree)
    texts, contexts = [t for t, *_ in got], [c for *_, c in got]
    assert texts[0] == "import os\nimport re" and contexts[0] == ""
    assert any(t.startswith("def first") and c == "Big" for t, _, _, c in got) and texts[-1].startswith("def tail")
    for t, a, b, _ in got:
        assert t.splitlines()[0].strip() in SOURCE.splitlines()[a - 1] and t.splitlines()[-1].strip() in SOURCE.splitlines()[b - 1]
    assert [c for *_, c in syntax.chunks_of(SOURCE, 10_000, syntax.python_tree)] == [""]
    assert syntax.chunks_of("def broken(:", 70, syntax.python_tree) == [] and syntax.chunks_of("", 70, syntax.python_tree) == []
    long_ = "x = [\n" + "".join(f"    {i},\n" for i in range(200)) + "]\n"
    parts = syntax.chunks_of(long_, 50, syntax.python_tree)
    assert len(parts) > 5 and "".join("".join(t.split()) for t, *_ in parts) == "".join(long_.split())


def test_syntax_documents(spark):
    files = spark.createDataFrame([("a.py", SOURCE), ("b.py", "def broken(:\nrest"), ("c.md", "Title\n\nbody"), ("d.py", None)], "path string, text string")
    got = syntax.documents(files, 70).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source_path].append(r)
    assert len(by["a.py"]) >= 3 and [r.text for r in by["b.py"]] == ["def broken(: rest"] and by["c.md"][0].context == "" and "d.py" not in by
    assert all(r.docid == f"{r.source_path}:{r.start_line}-{r.end_line}" for r in got)


# -- spans and consolidation


def test_span_groups_are_first_fit(spark):
    rng, rows = random.Random(5), []
    for q in range(60):
        for i in range(rng.randint(1, 9)):
            a = rng.randint(1, 30)
            rows.append((q, "lexical", i, f"d{i}", rng.choice("pq"), a, a + rng.randint(0, 6), i, "", None))
    hits = spark.createDataFrame(rows, "query_id int, retriever string, pos int, docid string, source_path string, start_line int, end_line int, rank int, context string, metadata string")
    for adjacent in (True, False):
        got = defaultdict(set)
        for r in consolidation.span_groups(hits, adjacent).collect():
            got[r.query_id, r.source_path, r.grp].add(r.docid)
        want = []
        for key in {(r[0], r[4]) for r in rows}:
            groups: list[list] = []
            for r in sorted((r for r in rows if (r[0], r[4]) == key), key=lambda r: (r[5], r[6], r[3])):
                home = next((g for g in groups if any(r[5] <= m[6] and m[5] <= r[6] or adjacent and (m[6] + 1 == r[5] or r[6] + 1 == m[5]) for m in g)), None)
                groups.append([r]) if home is None else home.append(r)
            want += [(*key, frozenset(r[3] for r in g)) for g in groups]
        assert Counter((q, p, frozenset(ids)) for (q, p, _), ids in got.items()) == Counter(want)


# -- evaluation


def brute_ndcg(hits: list[list[int]], golds: int, k: int) -> float:
    claimed, dcg = set(), 0.0
    for p, found in enumerate(hits[:k], 1):
        free = [g for g in sorted(found) if g not in claimed]
        if free:
            claimed.add(free[0])
            dcg += 1 / math.log2(p + 1)
    return dcg / sum(1 / math.log2(p + 1) for p in range(1, min(k, golds) + 1)) if golds else 0.0


def test_ndcg_claims_each_gold_once(spark):
    rng, hits, golds, want = random.Random(8), [], [], {}
    for q in range(40):
        spans = [(a := rng.randint(1, 20), a + rng.randint(0, 5)) for _ in range(rng.randint(0, 4))]
        golds += [(q, i, "x/f.py", a, b) for i, (a, b) in enumerate(spans)]
        found = [(a := rng.randint(1, 20), a + rng.randint(0, 5)) for _ in range(rng.randint(1, 8))]
        hits += [(q, "arm", r, "f.py", a, b) for r, (a, b) in enumerate(found)]
        meets = [[g for g, (s, e) in enumerate(spans) if a <= e and s <= b] for a, b in found]
        want[q] = (len({g for m in meets[:5] for g in m}) / len(spans) if spans else 0.0, brute_ndcg(meets, len(spans), 5))
    h = spark.createDataFrame(hits, "query_id int, arm string, rank int, source_path string, start_line int, end_line int")
    g = spark.createDataFrame(golds, "query_id int, gold_idx int, source_path string, start_line int, end_line int")
    got = {r.query_id: (r.recall, r.ndcg) for r in evaluation.evaluate(h, g).collect()}
    assert set(got) == set(want) and all(got[q] == pytest.approx(want[q]) for q in want)


def test_confidence_validity_of_an_empty_bucket(spark):
    pairs = spark.createDataFrame([("high", True), ("low", False)], "confidence string, is_relevant boolean")
    got = {r.confidence: (r.total, r.precision, r.monotonic) for r in evaluation.confidence_validity(pairs).collect()}
    assert got == {"high": (1, 1.0, True), "medium": (0, None, True), "low": (1, 0.0, True)}


# -- dense, tuning


def test_dense_search_is_exact(spark):
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(90, 8)), rng.normal(size=(4, 8))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "doc_idx long, vector array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id int, vector array<double>")
    got = defaultdict(list)
    for r in dense.dense_search(vectors, asked, 7).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.doc_idx)
    assert all(got[i] == np.argsort(-(x @ q[i]), kind="stable")[:7].tolist() for i in range(4))
    near = vectors.where("vector is not null").select("vector", dense.quantised(F.col("vector"), 4).alias("r")).collect()
    assert all(np.corrcoef(r.vector, r.r)[0, 1] > 0.97 for r in near)


def test_precedence_and_empty_corpus(spark):
    none = spark.createDataFrame([(0.0, None, None, None, None, None, 0.0)], "code_fraction double, median_code_lines double, n_chunks long, chunk_token_cv double, p50_chunk_tokens double, p90_chunk_tokens double, cjk_fraction double")
    got = tuning.resolve(none, {"bm25_k1": 9.0, "bm25_b": None})
    assert (got["bm25_k1"], got["bm25_b"], got["bit_width"], got["tokenizer"]) == (9.0, 0.75, 4, "plain")
    assert one(spark, 600.0, tuning.top_k, "double") == 5 and one(spark, 200.0, tuning.top_k, "double") == 8 and one(spark, None, tuning.top_k, "double") == 5
    assert tuning.thin_warning(3.0) and tuning.thin_warning(20.0) is None


def test_fused_top_is_that_of_whole_rankings(spark):
    """The fusion of few candidates against both rankings sorted whole, with ties and a term in all rows."""
    rng = random.Random(3)
    words = ["common", *(f"w{i}" for i in range(12))]
    docs = [(i, str(i), "common " + " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for i in range(400)]
    index = lexical.LexicalIndex.of(spark.createDataFrame(docs, "doc_idx long, docid string, text string"))
    asked = spark.createDataFrame([(q, " ".join(rng.choice(words) for _ in range(4))) for q in range(6)], "query_id int, query string")
    k, by = 3, {}
    for r in lexical.lexical_scores(index, asked).collect():
        by.setdefault(r.query_id, []).append((r.doc_idx, r.tfidf, r.bm25))
    want = {}
    for q, rows in by.items():
        t = {d: i for i, (d, *_) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
        m = {d: i for i, (d, *_) in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])))}
        want[q] = sorted(t, key=lambda d: (-round(1 / (61 + t[d]) + 1 / (61 + m[d]), 12), t[d]))[:k]
    got = {}
    for r in lexical.lexical_search(index, asked, k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_idx)
    assert got == want and len(got) == 6
    some = lexical.lexical_scores(index, asked).where("doc_idx % 7 = 0")
    ranks = lexical.placed(some, lexical.lexical_scores(index, asked), "bm25", "m").collect()
    whole = {(q, d): i for q, rows in by.items() for i, (d, *_) in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])))}
    assert len(ranks) > 6 and all(r.m == whole[r.query_id, r.doc_idx] for r in ranks)


def test_index_whose_rare_terms_are_dealt_out(spark):
    """Few common terms: the others' postings go by term, and all weights and ranks are those of an index without such."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefghij") + rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_idx long, text string").withColumn("docid", F.col("doc_idx").cast("string"))
    asked = spark.createDataFrame([(i, texts[i][:40]) for i in range(6)], "query_id int, query string")
    found = {}
    for common in (0, 5, 1000):
        index = lexical.LexicalIndex.of(docs, common=common)
        weights = {(r.doc_idx, r.term): (r.tf, r.dl, r.df, round(r.w, 9)) for r in index.postings.collect()}
        found[common] = weights, sorted((r.query_id, r["rank"], r.doc_idx, round(r.score, 9)) for r in lexical.lexical_search(index, asked, 7).collect())
        for q, words in ((i, texts[i][:40]) for i in range(6)):
            assert [(d, s) for i, _, d, s in found[common][1] if i == q] == [(d, round(s, 9)) for d, s in brute_lexical(texts, words)][:7]
    assert found[0] == found[5] == found[1000]
    for d, text in enumerate(texts):
        assert {t: found[0][0][d, t][:2] for t in set(text.split())} == {t: (text.split().count(t), len(text.split())) for t in set(text.split())}


def test_gaps_and_first_places():
    rng = np.random.default_rng(6)
    for _ in range(50):
        score, doc = rng.integers(0, 6, 40) / 2, rng.permutation(40)
        order = np.lexsort((doc, -score))
        edges = np.sort(rng.choice(40, rng.integers(1, 12), replace=False))
        s, d = score[order][edges], doc[order][edges]
        assert (scoring.gaps(s, d, score[order], doc[order]) == np.searchsorted(edges, np.arange(40), "left")).all()
        best = scoring.Firsts(5, 3, 1)
        query = rng.integers(0, 3, 40)
        for a in range(0, 40, 9):
            best.offer(query[a : a + 9], doc[a : a + 9], [score[a : a + 9]])
            best.cut()
        got = list(zip(*best.cut(), strict=True))
        assert got == [x for q in range(3) for x in sorted(((q, d, s) for q2, d, s in zip(query, doc, score, strict=True) if q2 == q), key=lambda x: (-x[2], x[1]))[:5]]
    assert list(scoring.slices(np.array([3, 0, 9, 1, 1, 0]), 4)) == [(0, 2), (2, 3), (3, 6)]
