"""The near-duplicate stage against all pairs of five-word shingle sets."""

from __future__ import annotations

import random

import numpy as np

from quarry.llm import exact, similar, simhash

SCHEMA = "doc_id long, text string, lang string"


def shingles(text: str | None) -> set[tuple]:
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def edited(rng: random.Random, text: str, edits: int) -> str:
    words = text.split()
    for k in rng.sample(range(len(words)), edits):
        words[k] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def brute(texts: list[str | None]) -> list[int]:
    sets, root = list(map(shingles, texts)), list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    return root


def corpus() -> list[str | None]:
    rng = random.Random(11)
    plain = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(5, 250))) for _ in range(40)]
    common = " ".join(f"c{i}" for i in range(30))
    texts = [*plain, *(common + " " + x for x in plain[:20]), "one two", "One  TWO", "one two three", None, "", " \n", "x"]
    texts += [edited(rng, x, e) for x in plain if len(x.split()) > 60 for e in (1, 2, 3, 4, 5, 6)]
    base = " ".join(f"b{i}" for i in range(120))
    return texts + [edited(rng, base, rng.randrange(4)) for _ in range(60)]  # copies of which many are apart but for others


def test_near_dedup_keeps_one_of_each_group(spark):
    texts = corpus()
    docs = spark.createDataFrame([(3 * i, x, "en") for i, x in enumerate(texts)], SCHEMA).repartition(5)
    want = {3 * r for r in brute(texts)}
    assert {r.doc_id for r in simhash.representatives(docs).collect()} == want
    assert {r.doc_id: r.set for r in similar.groups(docs).collect()}.keys() == {3 * i for i in range(len(texts))}
    two_bits = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert len(want) < len(two_bits)


def test_frequent_shingles_change_nothing(spark, monkeypatch):
    texts = corpus()
    docs = spark.createDataFrame([(i, x, "en") for i, x in enumerate(texts)], SCHEMA).repartition(3)
    monkeypatch.setattr(similar, "FREQUENT", 5)
    monkeypatch.setattr(similar, "CHAINS", 1)
    assert {r.doc_id for r in simhash.representatives(docs).collect()} == set(brute(texts))


def test_repeated_rows_and_null_ids_leave_one(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(5, long, "en"), (5, long, "en"), (5, long, "de"), (None, long, "en"), (7, "other words here", "en"), (None, "no id", "en"), (None, "no id", "en"), (None, None, None), (5, "another text under five", "en")]
    for f in (simhash.representatives, exact.kept_documents):
        got = f(spark.createDataFrame(rows, SCHEMA)).collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted({(5, long), (7, "other words here"), (None, "no id"), (None, None), (5, "another text under five")}, key=repr)


def test_fingerprints_lose_nothing():
    rng = random.Random(5)
    for _ in range(300):
        base = [rng.getrandbits(64) for _ in range(rng.randint(1, 200))]
        other = [x for x in base if rng.random() > 0.1] + [rng.getrandbits(64) for _ in range(rng.randint(0, 20))]
        a, b = (np.unique(np.array(x, np.uint64)) for x in (base, other or [1]))
        differ = sum(bin(x ^ y).count("1") for x, y in zip(similar.fingerprint(a), similar.fingerprint(b), strict=True))
        assert differ <= len(np.setxor1d(a, b)) and len(similar.fingerprint(a)) * 8 == similar.FINGERPRINT
        if similar.similar(len(np.intersect1d(a, b)), len(a), len(b)):
            assert similar.within(differ, len(a), len(b))


def test_threshold_is_exact():
    assert similar.similar(8, 9, 9) and not similar.similar(8, 9, 10) and similar.similar(4, 5, 4)


def test_trie_pairs_are_near_and_a_forest():
    rng, masks = random.Random(8), [int(m) for m in simhash.byte_masks()]
    for budget in (2, 6, 10):
        base = [rng.getrandbits(64) for _ in range(3)]
        fps = sorted({b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(9))) for b in base for _ in range(40)})
        a, b = simhash.trie_pairs(np.array(fps, np.uint64), np.zeros(len(fps), np.int64), budget)
        near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= budget]
        pairs = list(zip(a.tolist(), b.tolist(), strict=True))
        assert set(pairs) <= set(near) and near
        roots = []
        for links in (pairs, near):
            root = list(range(len(fps)))
            for i, j in links:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
            roots.append(root)
        assert roots[0] == roots[1] and len(pairs) == len(fps) - len(set(roots[1]))  # as whole, without a link too many
        assert all(any(fps[i] & m == fps[j] & m for m in masks) for i, j in near if (fps[i] ^ fps[j]).bit_count() <= 8 - simhash.BYTES)


def test_near_dedup_links_by_simhash_first_and_the_rest_exactly(spark, monkeypatch):
    rng = random.Random(12)
    plain = [" ".join(f"w{rng.randrange(3000)}" for _ in range(200)) for _ in range(30)]
    texts = [*plain, *(edited(rng, x, e) for x in plain for e in (1, 2, 6))]
    docs = spark.createDataFrame([(i, x, "en") for i, x in enumerate(texts)], SCHEMA).repartition(3)
    root = brute(texts)
    number = {similar.identity(similar.shingles(x.encode())): i for i, x in enumerate(texts)}
    # by SimHashes alone: pairs within the budget, most of the links
    rows = similar.prefixes(docs).cache()
    fps = {r.set: r.fp & (1 << 64) - 1 for r in rows.collect()}
    for i, x in enumerate(texts):
        hashes = similar.shingles(x.encode()).tolist()
        assert fps[similar.identity(np.array(hashes, np.uint64))] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)), i
    pairs = similar.simhash_pairs(rows, 1).collect()
    assert pairs and all((fps[r.a] ^ fps[r.b]).bit_count() <= simhash.WIDE for r in pairs)
    found = {(number[r.a], number[r.b]) for r in pairs}
    assert sum(root[a] == root[b] for a, b in found) > len(plain)
    # the stage uses them, and loses nothing without them
    asked = []
    real = similar.simhash_pairs
    monkeypatch.setattr(similar, "simhash_pairs", lambda *given: asked.append(1) or real(*given))
    assert {r.doc_id for r in simhash.representatives(docs).collect()} == set(root) and asked
    monkeypatch.setattr(similar, "simhash_pairs", lambda *given: real(*given).where("false"))
    assert {r.doc_id for r in simhash.representatives(docs).collect()} == set(root)
