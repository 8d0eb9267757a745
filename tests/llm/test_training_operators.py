"""Each operator against a brute-force version on small fixtures with nulls, ties, repeats, empty and long texts."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import edits, exact, language, licenses, mixing, packing, phrases, quality, shared, simhash, token_counts
from quarry.llm.components import components
from quarry.llm.vocabulary import default_path, encoded, pre_tokens, tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string"


def sentence(rng: random.Random, n: int, words: str = "thon ing and the re stion ead ous nel var kip tor") -> str:
    parts = words.split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus() -> list[tuple]:
    rng = random.Random(7)
    texts = [sentence(rng, rng.randint(1, 400)) for _ in range(60)]
    texts += [texts[3], texts[3], texts[5].replace(" ", "\n\t "), texts[9] + " more", None, "", " \n ", "x", "a" * 5000, sentence(rng, 6000)]
    shared = sentence(rng, 70)
    texts += [sentence(rng, 30) + " " + shared + " " + sentence(rng, 40) for _ in range(6)] + [shared, " ".join(shared.split()[8:66])]
    texts += ["Grüße aus München — 你好 世界 \U0001f600 <|endoftext|> end", "one  two three ​ four\r\n\n five "]
    rows = [(3 * i, t, ("en", "de", None)[i % 3], (None, "a", "b", "hot", "hot")[i % 5], None if t is None else len(t), "clash", "clash") for i, t in enumerate(texts)]
    return rows + [rows[4], rows[4], (None, "no id here", "en", "a", 10, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for f in (token_counts.token_counts, language.predict, packing.pack, lambda d: quality.rate(d, labels), simhash.near_duplicates, phrases.remove_repeats, licenses.scan_documents, mixing.mix, edits.fingerprints, exact.exact_dedup, language.accepted, exact.kept_documents, simhash.representatives, mixing.mixed_documents):
        assert f(empty).collect() == []


def test_token_counts_of_hot_pre_tokens(docs, corpus, monkeypatch):
    """One pre-token outside the vocabulary in all rows is dealt by block; the counts are the same."""
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", 200)
    rows = [(i, f"zzqxjk{(i or 0) % 2}vv zzqxjkhot {x or ''}") for i, x, *_ in corpus]
    d = docs.sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(3)
    t = tokenizer(default_path())
    want = Counter((i, len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for i, x in rows)
    for least in (1, 512):
        monkeypatch.setattr(token_counts, "HOT_BYTES", least)
        assert Counter(tuple(r)[:3] for r in token_counts.token_counts(d).collect()) == want


def test_token_counts(docs, corpus):
    t = tokenizer(default_path())
    want = Counter((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for i, x, *_ in corpus)
    assert Counter(map(tuple, token_counts.token_counts(docs).collect())) == want


def test_pre_tokens_join_to_the_text(corpus):
    t = tokenizer(default_path())
    for _, x, *_ in corpus:
        pieces = pre_tokens(x or "", default_path())
        assert "".join(pieces) == (x or "")
        assert sum(len(t.encode(p, add_special_tokens=False).ids) for p in pieces) == len(t.encode(x or "", add_special_tokens=False).ids)


def test_fast_ids_are_the_librarys():
    rng, t = random.Random(1), tokenizer(default_path())
    chars = "ab Zé ß,.!?'\n\t  09²½ 你  ​'ll're\x85́"
    for _ in range(3000):
        x = "".join(rng.choice(chars) for _ in range(rng.randint(0, 40)))
        assert encoded(x, default_path()) == t.encode(x, add_special_tokens=False).ids


def test_language(spark):
    rng = random.Random(3)
    own = {"xx": "ka lo mi ren tas", "yy": "sch ung ber ich keit"}
    rows = [(i, sentence(rng, 30, own[lang]), lang) for i, lang in enumerate(["xx", "yy"] * 60)] + [(500, None, "xx"), (501, "12 !!", "yy"), (502, "", None), (None, "ich ber", "yy"), (503, "kalomi" * 900, None)]
    got = language.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, _, lang in rows[:120]:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert by[i].lang_pred == lang and 0.5 <= by[i].score <= 1
    assert [(by[i].lang_pred, by[i].score) for i in (500, 501, 502)] == [("und", 0.0)] * 3
    assert by[503].lang_pred == "xx" and by[None].lang_pred == "yy" and not by[None].held_out


def test_forward_sums_all_segmentations():
    vocabulary, rng = language.pieces(default_path("piece_bpe_32k.model")), np.random.default_rng(0)
    p = rng.random((vocabulary.other + 1, 2))
    p /= p.sum(axis=0)
    index = {n: i for i, n in enumerate(vocabulary.names)}

    def cuts(w: str) -> list[list[int]]:
        if not w:
            return [[]]
        out = []
        for k in range(1, len(w) + 1):
            if (i := index.get(w[:k], vocabulary.other if k == 1 else None)) is not None:
                out += [[i, *rest] for rest in cuts(w[k:])]
        return out

    items = ["▁the", "▁schön", "▁ñandú", "aaaa", "▁ж"]
    got = language.log_likelihood(vocabulary, items, p)
    ones = language.expected_counts(vocabulary, items, np.eye(len(items)))
    for i, w in enumerate(items):
        ways = cuts(w)
        assert np.allclose(got[i], np.log(sum(np.prod(p[c], axis=0) for c in ways)))
        weight = [(1 / (vocabulary.other + 1)) ** len(c) for c in ways]
        want = np.zeros(len(p))
        for c, x in zip(ways, weight, strict=True):
            np.add.at(want, c, x / sum(weight))
        assert np.allclose(ones[:, i], want)


def test_long_pieces_and_long_words():
    vocabulary, rng = language.pieces(default_path("piece_bpe_32k.model")), np.random.default_rng(1)
    assert max(map(len, vocabulary.names)) == vocabulary.longest > 8
    p = rng.random((vocabulary.other + 1, 2)) ** 8 * 1e-3
    index = {n: i for i, n in enumerate(vocabulary.names)}

    def logarithms(w: str, q: np.ndarray) -> list[float]:
        """By logarithms, so that no length is too long."""
        a = [0.0]
        for i in range(1, len(w) + 1):
            terms = [a[i - k] + math.log(q[j]) for k in range(1, i + 1) if i - k >= max(0, i - 20) and (j := index.get(w[i - k : i], vocabulary.other if k == 1 else None)) is not None]
            top = max(terms)
            a.append(top + math.log(sum(math.exp(t - top) for t in terms)))
        return a

    long = max(vocabulary.names, key=len)
    items = [long, "▁confidence" * 3, "▁" + "straße" * 9, "a" * 31, "a" * 32, "a" * 33, "ж" * 400, "▁" + "kalomiren" * 300]
    got = language.log_likelihood(vocabulary, items, p)
    for i, w in enumerate(items):
        assert np.allclose(got[i], [logarithms(w, p[:, k])[-1] for k in range(2)], rtol=1e-9)
    ones = language.expected_counts(vocabulary, items, np.eye(len(items)))
    same = np.full(len(p), 1 / (vocabulary.other + 1))
    for i, w in enumerate(items):
        front, back = logarithms(w, same), {}
        for a in range(len(w), -1, -1):
            terms = [0.0] if a == len(w) else [back[a + k] + math.log(same[0]) for k in range(1, min(20, len(w) - a) + 1) if w[a : a + k] in index or k == 1]
            back[a] = max(terms) + math.log(sum(math.exp(t - max(terms)) for t in terms))
        want = np.zeros(len(p))
        for a in range(len(w)):
            for k in range(1, min(20, len(w) - a) + 1):
                if (j := index.get(w[a : a + k], vocabulary.other if k == 1 else None)) is not None:
                    want[j] += math.exp(front[a] + back[a + k] + math.log(same[0]) - front[-1])
        assert np.allclose(ones[:, i], want)
    assert language.words("Ab-cd " + "x" * 50) == ["▁ab", "▁cd", "▁" + "x" * 50]


def test_language_of_awkward_tables(spark):
    rng = random.Random(6)
    own = {"xx": "ka lo mi ren tas", "yy": "sch ung ber ich keit"}
    rows = [(i, sentence(rng, 30, own[lang]), lang, "clash", lang) for i, lang in enumerate(["xx", "yy"] * 40)]
    rows += [rows[0], rows[0], (200, "kalomi" * 20_000, None, None, None), (None, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, lang_pred string")
    got = Counter((r.doc_id, r.lang_pred) for r in language.predict(d).collect())
    assert got == Counter((i, "und" if x is None else lang or "xx") for i, x, lang, *_ in rows)
    kept = language.accepted(d)
    assert kept.columns == d.columns and Counter(map(tuple, kept.collect())) == Counter(r for r in rows if r[1])
    with pytest.raises(ValueError, match="__q_"):
        language.accepted(d.withColumn("__q_lang", F.lit(1)))


def test_packing(docs, corpus):
    got = packing.pack(docs, group_pieces=50).collect()
    ids = {i: np.array([*encoded(x or "", default_path()), 2], "<u4") for i, x, *_ in corpus if i is not None}
    repeats = Counter(i for i, *_ in corpus)
    by_doc, by_sequence = defaultdict(set), defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        if r.doc_id is not None:
            by_doc[r.doc_id].add((r.piece, r.start, r.length, r.ids_crc32))
    for i, pieces in by_doc.items():
        at = 0
        for k, (piece, start, length, crc) in enumerate(sorted(pieces)):
            assert (piece, start) == (k, at) and 0 < length <= 1024 and crc == zlib.crc32(ids[i][at : at + length].tobytes())
            assert length == 1024 or k == 0
            at += length
        assert at == len(ids[i])
    assert len(got) == sum(n * len(by_doc[i]) for i, n in repeats.items() if i is not None) + 2
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert set(by_doc) == set(ids)


def test_sum_of_squares_places_by_the_rule():
    rng = random.Random(5)
    for _ in range(30):
        lengths = [rng.randint(1, 20) for _ in range(60)]
        first = rng.random() < 0.5
        bins, offsets = packing.sum_of_squares(np.array(lengths), 20, first)
        level: dict[int, int] = {}
        for s, b, o in zip(lengths, bins.tolist(), offsets.tolist(), strict=True):
            gaps = Counter(20 - x for x in level.values() if x < 20)

            def total(gap: int) -> int:
                after = gaps - Counter([gap]) + Counter([gap - s] if gap > s else [])
                return sum(n * n for n in after.values())

            fits = [g for g in gaps if g >= s]
            assert level.get(b, 0) == o and (o > 0 or b not in level)
            if fits and first:
                assert total(20 - o) == min(map(total, fits)) and o
            else:
                assert total(20 - o) == min(map(total, [*fits, 20]))
            level[b] = o + s


def test_packing_needs_few_bins():
    rng = np.random.default_rng(3)
    lengths = np.sort(np.concatenate([rng.integers(1, 1024, 4000), rng.integers(1, 60, 2000)]))[::-1]
    for some in (lengths, lengths[::40]):
        bins, _ = packing.fewest(some, 1024)
        least = -(-some.sum() // 1024)
        print("bins", bins.max() + 1, "lower bound", least)
        assert bins.max() + 1 <= 1.002 * least + 1
        assert bins.max() <= min(packing.sum_of_squares(some, 1024, first)[0].max() for first in (False, True))
    assert [len(x) for x in packing.fewest(np.array([], np.int64), 1024)] == [0, 0]


def test_fingerprints_and_components(docs, corpus):
    def brute(text: str | None) -> int:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        if not words:
            return 0
        grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
        hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{brute(x):016x}") for i, x, *_ in corpus)
    fps = [(int(r.fingerprint, 16), r.doc_id) for r in got]
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(len(fps)):
            if (fps[i][0] ^ fps[j][0]).bit_count() <= 2:
                old, new = root[j], root[i]
                root = [new if x == old else x for x in root]
    for k, r in enumerate(got):
        ids = [fps[j][1] for j in range(len(fps)) if root[j] == root[k] and fps[j][1] is not None]
        assert r.component_id == min(ids, default=None)


def test_trie_links_and_keys():
    rng, masks = random.Random(2), [int(m) for m in simhash.key_masks()]
    for _ in range(60):
        base = [rng.getrandbits(64) for _ in range(3)]
        fps = sorted({b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(5))) for b in base for _ in range(20)})
        a, b = simhash.trie_links(np.array(fps, np.uint64), np.zeros(len(fps), np.int64))
        got, want = ([{i} for i in range(len(fps))] for _ in range(2))
        near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
        for links, sets in ((zip(a.tolist(), b.tolist(), strict=True), got), (near, want)):
            for i, j in links:
                sets[i] |= sets[j]
                for x in sets[i]:
                    sets[x] = sets[i]
        assert got == want
        assert all(any(fps[i] & m == fps[j] & m for m in masks) for i, j in near)
    assert all(m.bit_count() >= 44 for m in masks)


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(7, 9), (9, 8), (5, 5)]
    random.Random(0).shuffle(chain)
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {7: 7, 8: 7, 9: 7, 5: 5}


def test_components_with_hubs(spark, monkeypatch):
    from quarry.llm import components as module

    monkeypatch.setattr(module, "HUB", 3)
    rng = random.Random(4)
    links = [(1000, i) for i in range(60)] + [(i, 500 + i) for i in range(0, 60, 3)] + [(2000 + i, 3000) for i in range(20)] + [(rng.randrange(4000, 4100), rng.randrange(4000, 4100)) for _ in range(60)]
    root = {x: x for e in links for x in e}
    for _ in range(len(root)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    seen = module._hubs(spark.createDataFrame(links, "a long, b long"), len(links))
    assert {1000, 3000} <= set(seen)
    assert {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == root


def covered(rows: list[tuple], window: int) -> Counter:
    seen: dict[tuple, int] = {}
    for i, x, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (x or "").encode().split()
        for k in range(len(w) - window + 1):
            seen.setdefault(tuple(w[k : k + window]), i)
    out = Counter()
    for i, x, *_ in rows:
        w = (x or "").encode().split()
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and seen[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = [a for k, a in enumerate(w) if k not in gone]
        out[i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()] += 1
    return out


def test_substring_dedup(docs, corpus, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_DOCS", 4)
    assert Counter(map(tuple, phrases.remove_repeats(docs).collect())) == covered(corpus, 50)


def test_substring_dedup_gives_the_texts(docs, corpus):
    got = phrases.remove_repeats(docs, texts=True).collect()
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 and len(r.kept_text.split(" ")) == max(1, r.n_words - r.n_removed) for r in got)
    assert Counter(tuple(r)[:4] for r in got) == covered(corpus, 50)


def test_substring_dedup_of_few_words(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_DOCS", 7)
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in rng.sample(range(900), 60)]
    got = phrases.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=8).collect()
    assert Counter(map(tuple, got)) == covered(rows, 8)


def test_substring_dedup_deals_out_texts_that_may_repeat_only(spark, tmp_path, monkeypatch):
    """Texts without a recurring passage are in no exchange, and tables that are read no more are gone."""
    monkeypatch.setattr(shared, "shared_dir", lambda spark: str(tmp_path))
    rng = random.Random(13)
    rows = [(i, " ".join(rng.randbytes(8).hex() for _ in range(500))) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(0, 40, 10)]

    def dealt() -> int:
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(False).apply(0).totalShuffleWrite()

    docs, before = spark.createDataFrame(rows, "doc_id long, text string"), dealt()
    assert Counter(map(tuple, phrases.remove_repeats(docs).collect())) == covered(rows, 50)
    assert dealt() - before < 0.3 * sum(len(x) for _, x in rows)
    assert {p.name.split("-")[0] for p in tmp_path.iterdir()} == {"hits", "split"}


def test_substring_dedup_with_shared_marks(docs, corpus, monkeypatch):
    monkeypatch.setattr(phrases, "MARKS", 8)
    assert Counter(map(tuple, phrases.remove_repeats(docs).collect())) == covered(corpus, 50)


def test_license_scan(spark):
    mit = licenses.TEMPLATES["MIT"]
    altered = mit.replace("free of charge", "at no cost").replace("persons", "people")
    rows = [(1, "Some prose first. " + mit + " And after."), (2, altered), (3, "no such thing here, and no notice"), (4, None), (5, ""), (6, "licensed licensed licensed under under"), (7, "x " * 3000 + "Licensed under the Apache License, Version 2.0." + " y" * 3000), (None, "Released under the MIT License.")]
    got = {r.doc_id: r for r in licenses.scan_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    assert got[1].license == "MIT" and got[1].coverage == 1.0
    assert got[2].license == "MIT" and 0.9 < got[2].coverage < 1 and got[2].licenses == ["MIT"]
    assert [got[i].license for i in (3, 4, 5, 6)] == [None] * 4
    assert got[7].license == "Apache-2.0-notice" and got[None].license == "MIT-notice"


@pytest.mark.parametrize("name", ["MIT", "BSD-3-Clause", "Apache-2.0", "Unlicense"])
def test_license_scan_is_the_whole_texts_alignment(name):
    rng, template = random.Random(12), licenses.words(licenses.TEMPLATES[name])
    for n in (0, 1, 10, 20, 40, 80, 200):
        for _ in range(4):
            at, filler = rng.randint(0, len(template)), sentence(rng, n).split()
            text = sentence(rng, 50).split() + template[:at] + filler + template[at:] + sentence(rng, 300).split()
            whole = len(licenses.align(text, template)) / len(template)
            found = licenses.scan(" ".join(text))
            assert whole > 0.9 and len(found[name]) / len(template) >= whole
            assert licenses.ranked(found)[0][0] == name


def test_license_scan_misses_no_template():
    """Every template, altered by up to a fifth of its words, against alignment with all templates without any bound."""
    rng = random.Random(13)
    for name, template in licenses.templates().items():
        for part in (0, 0.05, 0.15):
            text = [w for w in template if rng.random() >= part]
            for copies in (1, 2, 5):
                held = " filler ".join([" ".join(text)] * copies)
                found = licenses.scan("before it " + held + " after it")
                for other, t in licenses.templates().items():
                    brute = licenses.matched(licenses.words("before it " + held + " after it"), t)
                    assert (other in found) == (len(brute) >= 0.8 * len(t) - 1e-9)
                if len(licenses.align(text, template)) >= 0.8 * len(template):
                    assert name in found and len(found[name]) >= len(licenses.align(text, template))


def test_license_scan_of_awkward_tables(spark):
    cc = "Licensed under CC BY 4.0."
    rows = [(1, f"{cc} Photo X. {cc}", "clash"), (1, f"{cc} Photo X. {cc}", "clash"), (2, "x " * 30_000 + cc + " y" * 30_000 + cc, None), (3, "GPLv3 in prose, licensed works, and far from it the Apache things under a License, later Version 2.0", None), (4, "\n".join([cc, "Released under the MIT License."]), None), (None, cc, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = Counter((r.doc_id, r.license, tuple(r.licenses)) for r in licenses.scan_documents(d).collect())
    by = "CC-BY-4.0-notice"
    assert got == Counter([(1, by, (by,)), (1, by, (by,)), (2, by, (by,)), (3, None, ()), (4, by, (by, "MIT-notice")), (None, by, (by,))])


def test_alignment_is_common_and_rising():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randint(0, 12))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x < y and s < t for (x, s), (y, t) in zip(pairs, pairs[1:], strict=False))
        assert licenses.align(a, a) == [(i, i) for i in range(len(a))]
        order = [(i, rng.randint(0, 9)) for i in range(rng.randint(0, 8))]
        parts = [[o for k, o in enumerate(order) if m >> k & 1] for m in range(1 << len(order))]
        best = max(len(x) for x in parts if all(a[1] < b[1] for a, b in zip(x, x[1:], strict=False)))
        assert len(licenses.longest_increasing(order)) == best


def brute_mix(rows: list[tuple]) -> Counter:
    sizes = [(i, s, len((x or "").encode().split())) for i, x, _, s, *_ in rows]
    by = Counter()
    for _, s, n in sizes:
        by[s] += n
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weight, total, capped = {s: k % 3 + 1 for k, s in enumerate(names)}, sum(by.values()), set()
    while True:
        left = total - sum(3 * by[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * by[s] if s in capped else left * weight[s] / share for s in names}
        over = {s for s in names if target[s] > 3 * by[s]}
        if not over:
            break
        capped |= over
    queue, at = [], Counter()
    for k, (i, s, n) in enumerate(sorted(sizes, key=lambda r: (hashlib.md5(b"" if r[0] is None else str(r[0]).encode()).hexdigest(), r[0] is not None, r[0] or 0, r[2]))):
        queue.append((k, i, s, n, at[s]))
        at[s] += n
    packets = []
    for k, _, s, n, start in queue:
        most = max(1, min(256, int(target[s] // 1000)))
        for e in range(3):
            for x in range(0, n, most):
                begin = e * by[s] + start + x
                packets.append(((begin + min(most, n - x)) / target[s], names.index(s), begin, min(most, n - x), k))
    left, taken = total, Counter()
    for *_, n, k in sorted(packets):
        taken[k] += min(n, left)
        left -= min(n, left)
    return Counter((i, n, by[s], round(target[s], 6), taken[k]) for k, i, s, n, _ in queue)


def test_mixing(docs, corpus):
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == brute_mix(corpus)
    taken = Counter()
    for r in got:
        taken[r.source_size, r.target] += r.taken
    assert all(abs(n - target) <= max(2, 0.003 * target) for (_, target), n in taken.items())
    assert sum(taken.values()) == sum(r["size"] for r in got)


def test_mixed_documents_have_the_words_taken(docs, corpus):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len((r.text or "").encode().split())
    want = Counter()
    for (i, *_, taken), n in brute_mix(corpus).items():
        want[i] += taken * n
    assert got == +want


def test_edit_fingerprints(docs, corpus):
    order = sorted(((i, x or "") for i, x, *_ in corpus), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = Counter()
    for k, (i, x) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        q = len(x) // 4
        other = x[: len(x) - q] + following[:q]
        a, b, c = (edits.fingerprint(t) for t in (x, other, following))
        want[i, len(x), hashlib.sha256(other.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), edits.likeness(a, b), edits.likeness(a, c)] += 1
    assert Counter(map(tuple, edits.fingerprints(docs).collect())) == want


def test_fingerprint_by_plain_python():
    """The tuples of least numbered k-mers, by sorting whole tuples instead of packed numbers."""
    def mixed(x: int) -> int:
        return int(edits._mixed(np.array([x], np.uint64))[0])

    full, base, rng = (1 << 64) - 1, int(edits._BASE), random.Random(10)
    low = (1 << 28) - 1
    for text in ("", "a", "ab", "abcde", "abcabcabcabc" * 9, sentence(rng, 5), sentence(rng, 150)):
        codes, want = [ord(c) for c in text], []
        k = min(edits.K, len(codes))
        seen, numbered = Counter(), []
        for i in range(len(codes) - k + 1 if codes else 0):
            h = 0
            for c in codes[i : i + k]:
                h = (h * base + c) & full
            kmer = mixed(h) >> 28
            numbered.append((mixed((kmer * base + seen[kmer] + 1) & full) & ~low, i))
            seen[kmer] += 1
        numbered.sort()
        for v in range(edits.VALUES if codes else 0):
            first = sum(h < v << 58 for h, _ in numbered)
            chosen = sorted((numbered[(first + j) % len(numbered)] for j in range(edits.TUPLE)), key=lambda x: x[1])
            out = chosen[0][0] >> 28
            for h, _ in chosen[1:]:
                out = mixed((out * base + (h >> 28)) & full)
            want.append(mixed(out) >> 48)
        assert edits.fingerprint(text).tolist() == (want or [0] * edits.VALUES)


def test_longer_places_change_no_order(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(edits, "PLACE_BITS", 4)
    x = sentence(rng, 100)
    assert edits.likeness(edits.fingerprint(x), edits.fingerprint(x)) == 1 and edits.likeness(edits.fingerprint(x), edits.fingerprint(sentence(rng, 100))) < 0.5


def test_edit_ranges_meet(docs, monkeypatch):
    whole = Counter(map(tuple, edits.fingerprints(docs).collect()))
    monkeypatch.setattr(edits, "RANGE_DOCS", 5)
    assert Counter(map(tuple, edits.fingerprints(docs).collect())) == whole


def test_likeness_follows_edits():
    rng = random.Random(9)
    for _ in range(20):
        x, y = sentence(rng, 200), sentence(rng, 200)
        fx = edits.fingerprint(x)
        near, far = edits.likeness(fx, edits.fingerprint(edits.edited(x, y))), edits.likeness(fx, edits.fingerprint(y))
        moved = edits.likeness(fx, edits.fingerprint(" ".join(reversed(x.split(" ")))))
        assert edits.likeness(fx, edits.fingerprint(x)) == 1 and near > 0.15 and far < near and moved < 1


def test_exact_dedup(docs, corpus, monkeypatch):
    groups = defaultdict(list)
    normal = lambda x: re.sub("[\x20\x09-\x0d]+", " ", x or "")
    for i, x, *_ in corpus:
        groups[normal(x)].append(i)
    want = Counter()
    for i, x, *_ in corpus:
        ids = [j for j in groups[normal(x)] if j is not None]
        keep = min(ids, default=None)
        want[i, keep, len(groups[normal(x)]), i == keep, hashlib.sha256(normal(x).encode()).hexdigest()] += 1
    assert Counter(map(tuple, exact.exact_dedup(docs).collect())) == want
    monkeypatch.setattr(exact, "SHARD_DIGESTS", 10)
    assert Counter(map(tuple, exact.exact_dedup(docs).collect())) == want
    kept = exact.kept_documents(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(i for (i, *_, k, _) in want if k)


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5000):
        keys = rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64)
        mph = exact.PerfectHash(keys)
        assert sorted(mph.slots(keys).tolist()) == list(range(n))
        assert mph.slots(rng.integers(0, 1 << 63, (100, 2)).astype(np.uint64)).max(initial=-1) < max(n, 1)


def test_quality(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = sentence(rng, 60)
        rows.append((i, " | ".join(text.upper().split()) if bad else text + ".", "ab"[i % 2], "h0" if i < 300 else f"h{i % 7}"))
        if i % 3 == 0:
            labels.append((i, int(not bad)))
    rows += [(900, None, None, None), (None, "", "a", "h0"), rows[0]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    known = spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, quality int")
    got = quality.rate(d, known).collect()
    assert len(got) == len(rows)
    unseen = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 3]
    assert sum(r.keep == bool(r.doc_id % 4) for r in unseen) / len(unseen) > 0.95
    # posteriors from the document evidence again, by plain arithmetic
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    known_ = dict(labels)
    sites = defaultdict(list)
    for i, _, p, h in rows:
        r = by[i] if i is not None else next(r for r in got if r.doc_id is None)
        sites[h, p].append(round(known_.get(i, r.p_doc) * 1e6))
    base = (sum(known_.values()) + known_[0] + 1) / (len(known_) + 1 + 2)  # document 0 is there twice
    logit = lambda p: math.log(p / (1 - p))
    for r in got:
        want = 1 / (1 + math.exp(-(logit(min(max(r.p_site, 1e-6), 1 - 1e-6)) + logit(min(max(r.p_doc, 1e-6), 1 - 1e-6)) - logit(base))))
        assert abs(r.quality - want) < 1e-9 and r.keep == (r.quality >= 0.5)
    # a site's rate is between its own record and its host's
    for (h, p), q in sites.items():
        own = sum(q) / len(q) / 1e6
        host = [x for (g, _), v in sites.items() if g == h for x in v]
        rate = sum(host) / len(host) / 1e6
        for i, _, pp, hh in rows:
            if (hh, pp) == (h, p) and i is not None and len(q) > 20:
                assert min(own, rate) - 0.1 <= by[i].p_site <= max(own, rate) + 0.1


def test_quality_sample_is_the_least_hashes(spark, monkeypatch):
    x = lambda i: [float(i)] * len(quality.FEATURES)
    rows = [(i, x(i), float(i % 2)) for i in range(100)] + [(7, x(7), 1.0)] * 3000
    d = spark.createDataFrame(rows, "doc_id long, x array<double>, label double").repartition(6)
    order = d.select("doc_id", (F.shiftrightunsigned(F.xxhash64("doc_id", "x", "label"), 1)).alias("h")).orderBy("h").collect()
    for parted in (12, 2):
        monkeypatch.setattr(quality, "PARTED", parted)
        for n in (0, 1, 40, 1000, 3050, 5000):
            got, y = quality.fit_sample(d, n)
            assert len(got) == len(y) == min(n, len(rows))
            assert Counter(got[:, 0].tolist()) == Counter(float(r.doc_id) for r in order[:n])


def brute_quality(rows: list[tuple], labels: list[tuple]) -> dict[int, tuple[float, float, float]]:
    """(p_doc, p_site, quality) of each row of (doc_id, text, path, host), by plain arithmetic from the texts up."""
    known: dict[int, float] = {}
    for i, q in labels:
        if i is not None and q is not None:
            known[i] = max(known.get(i, 0.0), float(q))
    x = [quality.surface((r[1] or "").encode()) for r in rows]
    fitted = [(a, known[r[0]]) for a, r in zip(x, rows, strict=True) if r[0] in known]
    a, y = np.array([f[0] for f in fitted]), np.array([f[1] for f in fitted])
    mean, scale = a.mean(axis=0), a.std(axis=0) + 1e-9
    w, b = np.zeros(a.shape[1]), 0.0
    for _ in range(60):  # Newton's steps on the ridge likelihood, weights and intercept apart
        z = (a - mean) / scale
        p = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30)))
        v = p * (1 - p)
        h = np.block([[(z.T * v) @ z + np.eye(len(w)), (z.T @ v)[:, None]], [(z.T @ v)[None, :], np.array([[v.sum() + 1e-6]])]])
        step = np.linalg.solve(h, np.r_[z.T @ (y - p) - w, (y - p).sum() - 1e-6 * b])
        w, b = w + step[:-1], b + step[-1]
    p_doc = [1 / (1 + math.exp(-max(-30, min(30, float((v - mean) / scale @ w + b))))) for v in x]
    q = [round(known.get(r[0], p) * 1e6) / 1e6 for r, p in zip(rows, p_doc, strict=True)]
    path, host = defaultdict(list), defaultdict(list)
    for r, v in zip(rows, q, strict=True):
        path[r[3], r[2]].append(v)
        host[r[3]].append(v)

    def strength(sites: list[tuple[list[float], float]]) -> float:
        n = sum(len(v) for v, _ in sites)
        between = (sum(len(v) * (sum(v) / len(v) - m) ** 2 for v, m in sites) - sum(m * (1 - m) for _, m in sites)) / n
        spread = sum(len(v) * m * (1 - m) for v, m in sites) / n
        return min(max(round(spread / between - 1, 6), 1.0), 1e6) if between > 1e-9 else 1e6

    mean_all = sum(q) / len(q)
    m = strength([(v, mean_all) for v in host.values()])
    of_host = {h: (sum(v) + m * mean_all) / (len(v) + m) for h, v in host.items()}
    m = strength([(v, of_host[h]) for (h, _), v in path.items()])
    base = (y.sum() + 1) / (len(y) + 2)
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    out = []
    for r, p, v in zip(rows, p_doc, q, strict=True):
        s = path[r[3], r[2]]
        site = min(1.0, max(0.0, (sum(s) - v + m * of_host[r[3]]) / (len(s) - 1 + m)))
        out.append((r[0], p, site, 1 / (1 + math.exp(-(logit(site) + logit(p) - math.log(base / (1 - base)))))))
    return out


def test_quality_is_the_plain_arithmetic(spark):
    rng = random.Random(8)
    texts = [sentence(rng, rng.randint(1, 80)) + rng.choice([".", " |||", "!!", " 12 34"]) for _ in range(150)] + [None, "", "x " * 40_000]
    rows = [(i, x, rng.choice(["p", "q", None]), rng.choice(["h", "g", "k", None]), "clash", 0.5) for i, x in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id here", "p", "h", None, None)]
    labels = [(i, rng.randint(0, 1)) for i in range(0, 160, 2)] + [(2, 1), (None, 1), (4, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, label string, p_doc double").repartition(4)
    got = quality.rate(d, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(brute_quality(rows, labels), key=key), strict=True):
        assert g[0] == w[0] and np.allclose(g[1:4], w[1:], atol=2e-5) and g[4] == (g[3] >= 0.5)


def test_quality_without_labels(spark):
    d = spark.createDataFrame([(1, "some text", "en", "a")], "doc_id long, text string, lang string, source string")
    r = quality.rate(d, spark.createDataFrame([], "doc_id long, quality int")).first()
    assert abs(r.p_doc - 0.5) < 1e-9 and r.keep


def test_stage_filters_keep_columns(docs):
    for f in (language.accepted, exact.kept_documents, simhash.representatives):
        out = f(docs)
        assert out.columns == docs.columns and out.count() <= docs.count()
    assert language.accepted(docs).where(F.col("text").isNull()).count() == 0
