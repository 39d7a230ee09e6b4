"""Language identification: known words first, then shorter and shorter character n-grams."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C

LETTERS = regex.compile(r"[\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")
#: Lengths of the n-grams tried for a word that the sample lacks, with a mark at either end of the word.
GRAMS = (5, 4, 3, 2, 1)
SMOOTH = 0.5
#: Languages up to whose number their counts are broadcast.
MOST_LANGUAGES = 10_000
#: Bytes of the rows that a worker remembers, and of what Python adds to each.
REMEMBERED, EACH = 24 << 20, 200
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def gram_hashes(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of all words, with a mark at either end (none for single characters), and the place
    in `words` of each."""
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    ends = np.cumsum(sizes)
    first, count = (ends - sizes, np.maximum(sizes - n + 1, 0)) if n > 1 else (ends - sizes + 1, sizes - 2)
    at = C.ranges(first, count)
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        h = C.mixed(h * _STEP + points[at + k] + np.uint64(1))
    return h, np.repeat(np.arange(len(words)), count)


class LanguageModel:
    """Log frequencies for each language: of words, and of the n-grams of each length in GRAMS. Both are known by hash."""

    def __init__(self, counts: list[tuple[str, str, int]]):
        self.langs = sorted({lang for lang, _, _ in counts})
        at = {lang: k for k, lang in enumerate(self.langs)}
        place = {w: k for k, w in enumerate(dict.fromkeys(w for _, w, _ in counts))}
        table = np.zeros((len(place), len(self.langs)))
        np.add.at(table, ([place[w] for _, w, _ in counts], [at[lang] for lang, _, _ in counts]), [n for _, _, n in counts])
        words = list(place)
        hashes = word_hashes(words)
        order = np.argsort(hashes)
        self.words, self.word_logs, self.grams = hashes[order], self._logs(table)[order], {}
        for n in GRAMS:
            hashes, owner = gram_hashes(words, n)
            keys, place = np.unique(hashes, return_inverse=True)
            summed = np.zeros((len(keys), len(self.langs)))
            for k in range(len(self.langs)):
                summed[:, k] = np.bincount(place, table[owner, k], len(keys))
            self.grams[n] = keys, self._logs(summed)

    @staticmethod
    def _logs(counts: np.ndarray) -> np.ndarray:
        return np.log((counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * (len(counts) + 1))).astype(np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each word, a column for each language; of an unseen word the mean over its longest n-grams of
        which any is known, zeros where none is."""
        out = np.zeros((len(words), len(self.langs)))
        if not len(words) or not len(self.words):
            return out
        hashes = word_hashes(words)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        known = self.words[at] == hashes
        out[known] = self.word_logs[at[known]]
        open_ = np.flatnonzero(~known)
        for n in GRAMS:
            keys, logs = self.grams[n]
            if not len(open_) or not len(keys):
                break
            hashes, owner = gram_hashes([words[k] for k in open_.tolist()], n)
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            there = keys[at] == hashes
            at, owner = at[there], owner[there]
            n_known = np.bincount(owner, minlength=len(open_))
            some = n_known > 0
            for k in range(len(self.langs)):
                out[open_[some], k] = np.bincount(owner, logs[at, k], len(open_))[some] / n_known[some]
            open_ = open_[~some]
        return out


class Scorer:
    """A worker's memory of what white space parts in the texts it has met: the sum of the scores of the words in it."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.most = REMEMBERED // (8 * len(model.langs) + EACH)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.sums = np.zeros((0, len(self.model.langs)))
        self.letters = np.zeros(0, dtype=bool)

    def _learn(self, chunks: list[str]) -> None:
        cut = [LETTERS.findall(c) for c in chunks]
        words = list(dict.fromkeys(w for c in cut for w in c))
        place = {w: k for k, w in enumerate(words)}
        scores = self.model.scores(words)
        owner = np.repeat(np.arange(len(chunks)), [len(c) for c in cut])
        at = np.fromiter((place[w] for c in cut for w in c), dtype=np.int64, count=len(owner))
        sums = np.stack([np.bincount(owner, scores[at, k], len(chunks)) for k in range(len(self.model.langs))], axis=1)
        self.at.update(zip(chunks, range(len(self.at), len(self.at) + len(chunks))))
        self.sums = np.concatenate([self.sums, sums])
        self.letters = np.concatenate([self.letters, np.fromiter((LETTER.search(c) is not None for c in chunks), dtype=bool, count=len(chunks))])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and its score of each text."""
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.model.langs:
            return langs, scores
        cut = [t.lower().split() if t else [] for t in texts]
        every = set().union(*cut)
        if len(self.at) + len(new := every - self.at.keys()) > self.most:
            self.clear()
            new = every
        if new:
            self._learn(sorted(new))
        sizes = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        at = np.fromiter((self.at[c] for own in cut for c in own), dtype=np.int64, count=int(sizes.sum()))
        own = np.flatnonzero(sizes)
        if not len(own):
            return langs, scores
        begin = (np.cumsum(sizes) - sizes)[own]
        lettered = np.logical_or.reduceat(self.letters[at], begin)
        total = np.stack([np.add.reduceat(self.sums[at, k], begin) for k in range(len(self.model.langs))], axis=1)
        best = total.argmax(axis=1)
        share = 1.0 / np.exp(total - total[np.arange(len(own)), best][:, None]).sum(axis=1)
        for k in np.flatnonzero(lettered).tolist():
            langs[own[k]], scores[own[k]] = self.model.langs[best[k]], float(share[k])
        return langs, scores


def sample(docs: DataFrame, sample_docs: int) -> DataFrame:
    """doc_id and lang of the documents to learn from: sample_docs at most, dealt evenly over the languages."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang")).where("lang is not null and doc_id is not null").where(C.crc_fold(F.col("doc_id"), 5) != 0)
    # A language's smallest hashes: those below a bound that about twice as many pass, then exactly, so that few rows of
    # a very common language meet.
    rows = rows.withColumn("hash", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    if counts.limit(MOST_LANGUAGES + 1).count() <= MOST_LANGUAGES:
        counts = F.broadcast(counts)  # else the rows are dealt out by language
    few = rows.join(counts, "lang").where(F.col("hash").cast("double") * F.col("n") <= F.lit(float((2 * sample_docs + 100) << 31)))
    some = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("hash", "doc_id"))).where(F.col("rank") <= sample_docs)
    return some.orderBy("rank", "hash", "doc_id", "lang").limit(sample_docs).select("doc_id", "lang")


def fit(docs: DataFrame, sample_docs: int = 4000) -> LanguageModel:
    """Learns from the whole texts of a bounded sample: sample_docs documents whose crc32(doc_id) mod 5 is not 0."""
    chosen = sample(docs, sample_docs).withColumnRenamed("lang", "__lang")
    training = C.texts(docs).where("text is not null").join(F.broadcast(chosen), "doc_id").select("text", "__lang")  # sample_docs rows at most

    def count(batches):
        for batch in batches:
            found: dict = defaultdict(Counter)
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("__lang").to_pylist(), strict=True):
                found[lang].update(LETTERS.findall(text.lower()))
            rows = [(lang, w, n) for lang, words in found.items() for w, n in words.items()]
            yield C.batch_of(["lang", "word", "n"], [list(x) for x in zip(*rows, strict=True)] or [[], [], []], [pa.string(), pa.string(), pa.int64()])

    counts = training.mapInArrow(C.tidied(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    return LanguageModel(sorted(zip(*(counts.column(k).to_pylist() for k in range(3)), strict=True)))


_SCORERS: dict = {}


def _scorer(shared) -> Scorer:
    model = shared.value
    if _SCORERS.get("of") is not model:
        _SCORERS.update({"of": model, "scorer": Scorer(model)})
    return _SCORERS["scorer"]


def identify(docs: DataFrame, sample_docs: int = 4000) -> DataFrame:
    """doc_id, held_out, lang_pred, score, one row for each row of docs, repeated rows too; an empty table gives none.

    `und` with score 0 where the text is null, empty or has no letter, or nothing could be learned. held_out:
    crc32(doc_id as text) mod 5 is 0 (false for a null doc_id). Of equally likely languages the first by name is taken.
    Texts are read whole, in pieces of bounded bytes. Other columns of docs, whatever their names, are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, sample_docs))  # bounded by the sample

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = _scorer(shared).predict(piece.column("text").to_pylist())
        return C.batch_of(["doc_id", "lang_pred", "score"], [C.ids(piece), langs, scores], [pa.int64(), pa.string(), pa.float64()])

    out = C.map_slices(C.texts(docs), run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(C.crc_fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, sample_docs: int = 4000) -> DataFrame:
    """The rows of docs, with all their columns, whose language is not `und`: one pass, nothing is dealt out.

    Null and empty texts and those without a letter go; repeated rows stay or go together; an empty table stays empty.
    Where nothing could be learned, texts with a letter stay. Other columns pass through under any names.
    """
    C.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, sample_docs))  # bounded by the sample

    def run(batches):
        for piece in C.pieces(batches):
            scorer, texts = _scorer(shared), piece.column("text").to_pylist()
            known = [x != "und" for x in scorer.predict(texts)[0]] if scorer.model.langs else [bool(x and LETTER.search(x)) for x in texts]
            yield piece.filter(pa.array(known, type=pa.bool_()))

    return docs.mapInArrow(C.tidied(run), docs.schema)
