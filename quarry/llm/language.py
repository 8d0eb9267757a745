"""Language identification with unigram pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary, in lower case, with the mark of a word's start. A language's model is a
probability for each piece; a word's probability is the sum over all ways to cut it into pieces of the product of their
probabilities, which a forward pass computes. Texts are scored by the sum of their words' logarithms. The models are
learned in one pass over all training documents: a piece's expected count in a word, when all pieces are equally likely,
comes from a forward and a backward pass, and doesn't depend on the language, so words are counted first.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.shared import lean, own_columns
from quarry.llm.vocabulary import default_path

#: Longer words are scaled, at every SCALED-th letter, so that their probabilities stay within a double's range.
SCALED, LONG, TINY = 8, 16, 2.0**-400
SMOOTHING = 0.1
#: Distinct words that a task keeps.
KEPT = 200_000
#: Expected counts are summed as whole numbers of this part, so that no order of summing shows.
UNIT = 1e-6
_MARK = "▁"
_LETTERS = regex.compile(r"\p{L}+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Pieces:
    """The vocabulary's pieces in an open hash table that is looked up by whole arrays."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        own = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()))
        self.names = sorted({x for x in own if x.strip(_MARK) and _LETTERS.fullmatch(x.removeprefix(_MARK))} | {_MARK})
        self.other = len(self.names)  # a letter that is no piece
        self.longest = max(map(len, self.names))
        self.size = 1 << 18
        self.slot, self.held, self.probes = np.full(self.size, -1, np.int32), np.zeros(self.size, np.uint64), 0
        for i, name in enumerate(self.names):
            h = self.hashes(coded([name], len(name)), len(name))[0, 0]
            at, n = int(h >> np.uint64(46)), 1
            while self.slot[at] >= 0:
                at, n = (at + 1) % self.size, n + 1
            self.slot[at], self.held[at], self.probes = i, h, max(self.probes, n)

    @staticmethod
    def hashes(codes: np.ndarray, k: int) -> np.ndarray:
        """The hash of each run of k code points."""
        with np.errstate(over="ignore"):
            h = np.full((len(codes), codes.shape[1] - k + 1), k, np.uint64)
            for j in range(k):
                h = (h ^ codes[:, j : codes.shape[1] - k + 1 + j]) * _M1
                h ^= h >> np.uint64(29)
            return h * _M2

    def ids(self, codes: np.ndarray, k: int) -> np.ndarray:
        """The piece that each run of k code points is, or -1."""
        h = self.hashes(codes, k)
        at, out = (h >> np.uint64(46)).astype(np.int64), np.full(h.shape, -1, np.int32)
        for _ in range(self.probes):
            out = np.where((self.held[at] == h) & (self.slot[at] >= 0), self.slot[at], out)
            at = (at + 1) % self.size
        return out


def coded(words: list[str], width: int) -> np.ndarray:
    """Code points of words of the same length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(-1, width).astype(np.uint64)


@functools.lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def words(chunk: str) -> list[str]:
    """The runs of letters of a chunk in lower case, whole, each after the mark of a word's start."""
    return [_MARK + run for run in _LETTERS.findall(chunk.lower())]


#: Letters, of all words together, that are looked up at once.
AT_ONCE = 200_000


def _by_length(items: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.array([len(x) for x in items])
    for n in np.unique(lengths):
        at, step = np.flatnonzero(lengths == n), max(1, AT_ONCE // int(n))
        for k in range(0, len(at), step):
            yield int(n), at[k : k + step]


def _lattice(vocabulary: Pieces, items: list[str], n: int) -> dict[int, np.ndarray]:
    """By piece length, the piece that starts at each place; places without a one-letter piece have the `other` one."""
    codes = coded(items, n)
    out = {k: vocabulary.ids(codes, k) for k in range(1, min(vocabulary.longest, n) + 1)}
    out[1] = np.where(out[1] < 0, vocabulary.other, out[1])
    return out


def _forward(lattice: dict[int, np.ndarray], of: Callable[[int, int], np.ndarray], n: int, keep: bool) -> tuple[list, list]:
    """Sums over all segmentations of each prefix, and the logarithms by which they are too small.

    of(k, i) are the probabilities of the pieces of k letters that start at i. Without keep only the last sums stay."""
    longest, alpha, logs = max(lattice), [1.0], [0.0]
    for i in range(1, n + 1):
        first = i - len(alpha) if not keep else 0  # prefix that alpha[0] is
        alpha.append(sum(alpha[i - k - first] * of(k, i - k) for k in range(1, min(longest, i) + 1)))
        logs.append(logs[-1])
        if n > LONG and i % SCALED == 0:
            # the window that later sums are made of goes up together
            tiny = alpha[-1] < TINY
            if np.any(tiny):
                up = np.where(tiny, 1 / TINY, 1.0)
                alpha[-longest:] = [x * up for x in alpha[-longest:]]
                logs[-longest:] = [x - np.log(up) for x in logs[-longest:]]
        if not keep and len(alpha) > longest:
            alpha, logs = alpha[-longest:], logs[-longest:]
    return alpha, logs


def log_likelihood(vocabulary: Pieces, items: list[str], p: np.ndarray) -> np.ndarray:
    """(words, languages): the logarithm of each word's probability over all segmentations. p: (pieces + 1, languages)."""
    table = np.vstack([p, np.zeros(p.shape[1])])  # row -1: no piece
    out = np.zeros((len(items), p.shape[1]))
    for n, at in _by_length(items):
        lattice = _lattice(vocabulary, [items[i] for i in at], n)
        alpha, logs = _forward(lattice, lambda k, i: table[lattice[k][:, i]], n, False)  # noqa: B023
        out[at] = np.log(alpha[-1]) + logs[-1]
    return out


def expected_counts(vocabulary: Pieces, items: list[str], weights: np.ndarray) -> np.ndarray:
    """(pieces + 1, languages): expected counts, all pieces equally likely. weights: (words, languages) word counts."""
    p0, out = 1 / (vocabulary.other + 1), np.zeros((vocabulary.other + 1, weights.shape[1]))
    for n, at in _by_length(items):
        lattice = _lattice(vocabulary, [items[i] for i in at], n)
        p = {k: np.where(x >= 0, p0, 0.0) for k, x in lattice.items()}
        alpha, up = _forward(lattice, lambda k, i: p[k][:, i], n, True)  # noqa: B023
        # the sums of each suffix are those of the prefixes of the words turned round
        beta, down = _forward(lattice, lambda k, i: p[k][:, n - i - k], n, True)  # noqa: B023
        before, after = (np.log([np.broadcast_to(x, len(at)) for x in sums]) + np.array([np.broadcast_to(x, len(at)) for x in logs]) for sums, logs in ((alpha, up), (beta[::-1], down[::-1])))
        for k, ids in lattice.items():
            share = np.exp(before[: n - k + 1] + after[k:] + np.log(p0) - before[n])
            where, word = np.nonzero(ids.T >= 0)
            piece, part = ids.T[where, word], share[where, word]
            for lang in range(weights.shape[1]):
                out[:, lang] += np.bincount(piece, weights=part * weights[at[word], lang], minlength=len(out))
    return out


class _Numbered(dict):
    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for null ids."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, path: str | None = None) -> tuple[list[str], np.ndarray]:
    """(languages, p) learned from text and lang of the documents that are not held out and have both and an id.

    What comes to the driver is a number for each piece of the fixed vocabulary and language.
    """
    path = path or default_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(path)
        chunks, langs, pairs = _Numbered(), _Numbered(), []  # pairs of language and chunk, with their numbers

        def counted() -> Iterator[pa.RecordBatch]:
            pair, where = np.unique(np.concatenate([x for x, _ in pairs]), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([n for _, n in pairs]))
            pair = pair % (1 << 32) + (pair >> 32) * len(chunks)
            numbered, of_chunk, of_word = _Numbered(), [], []
            for i, chunk in enumerate(chunks):
                for w in words(chunk):
                    of_chunk.append(i)
                    of_word.append(numbered[w])
            by_chunk = np.zeros((len(chunks), len(langs)))
            by_chunk[pair % len(chunks), pair // len(chunks)] = n
            weights = np.zeros((len(numbered), len(langs)))
            np.add.at(weights, np.array(of_word, np.int64), by_chunk[np.array(of_chunk, np.int64)])
            total = np.rint(expected_counts(vocabulary, list(numbered), weights) / UNIT).astype(np.int64)
            piece, lang = np.nonzero(total)
            names = np.array(list(langs), object)
            yield pa.RecordBatch.from_arrays([pa.array(names[lang], pa.string()), pa.array(piece), pa.array(total[piece, lang])], ["lang", "piece", "n"])

        for batch in batches:
            met = [(langs[lang] << 32) + np.fromiter(map(chunks.__getitem__, text.as_py().split()), np.int64) for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True)]
            pairs.append(np.unique(np.concatenate([np.array([], np.int64), *met]), return_counts=True))
            if len(chunks) > KEPT:
                yield from counted()
                chunks, langs, pairs = _Numbered(), _Numbered(), []
        if pairs:
            yield from counted()

    learn = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = learn.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(lean(run), "lang string, piece long, n long")
    found = counts.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    total = np.zeros((pieces(path).other + 1, len(langs)))
    if langs:
        total[found["piece"], np.searchsorted(langs, found["lang"])] = found["n"] * UNIT
    return langs, (total + SMOOTHING) / (total + SMOOTHING).sum(axis=0)


def identified(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str | None = None) -> DataFrame:
    """docs with __q_lang and __q_score: the likeliest language of the text and its posterior, all equally likely before.

    A text that is null or has no letters, and any text where no language was learned, is `und` with score 0.
    """
    path = path or default_path("piece_bpe_32k.model")
    langs, p = model
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, chunks = pieces(path), _Numbered()
        names, scores = np.array([*langs, "und"], object), np.zeros((0, len(langs) + 1))

        def scored(new: list[str]) -> np.ndarray:
            """For each chunk, the sum of its words' logarithms by language, and its number of words."""
            numbered, of_chunk, of_word = _Numbered(), [], []
            for i, chunk in enumerate(new):
                for w in words(chunk):
                    of_chunk.append(i)
                    of_word.append(numbered[w])
            by_word = np.hstack([log_likelihood(vocabulary, list(numbered), p), np.ones((len(numbered), 1))])
            out = np.zeros((len(new), len(langs) + 1))
            np.add.at(out, np.array(of_chunk, np.int64), by_word[np.array(of_word, np.int64)])
            return out

        for batch in batches:
            ids = [np.fromiter(map(chunks.__getitem__, (x.as_py() or "").split()), np.int64) for x in batch.column(where)]
            if langs and len(chunks) > len(scores):
                scores = np.vstack([scores, scored(list(chunks)[len(scores) :])])
            best, score = np.full(len(ids), len(langs)), np.zeros(len(ids))
            for i, x in enumerate(ids if langs else ()):
                total = scores[x].sum(axis=0)
                if total[-1]:
                    best[i] = total[:-1].argmax()
                    score[i] = 1 / np.exp(total[:-1] - total[best[i]]).sum()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.string()), pa.array(score)], [*batch.schema.names, "__q_lang", "__q_score"])
            if len(chunks) > KEPT:
                chunks, scores = _Numbered(), scores[:0]

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField("__q_lang", T.StringType()), T.StructField("__q_score", T.DoubleType())]))


def predict(docs: DataFrame) -> DataFrame:
    """A row for each row of docs(doc_id, text, lang, ...): doc_id, held_out, lang_pred, score. Null ids are not held out
    and not learned from; an empty table gives no rows; other columns are not read."""
    found = identified(docs.select("doc_id", F.col("text").cast("string").alias("text")), fit(docs))
    return found.select(F.col("doc_id"), held_out().alias("held_out"), F.col("__q_lang").alias("lang_pred"), F.col("__q_score").alias("score"))


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, with their columns as they were, whose language is known with a score of `least` or more."""
    return identified(own_columns(docs), fit(docs)).where((F.col("__q_lang") != "und") & (F.col("__q_score") >= least)).drop("__q_lang", "__q_score")
