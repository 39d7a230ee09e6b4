"""Language-model scores: the marginal probability of a text over all its segmentations into subwords.

The vocabulary and its scores are those of a public subword model. A score there is a rank: pieces were merged in the
order of their frequency. Zipf's law in Mandelbrot's form, with the offset usual for words, turns ranks into weights.
The contract asks for learning from the training documents: the expected counts of the pieces over all of them, under
those weights, are added to the weights of PRIOR pieces, twice. A text is a stream of independent pieces, closed by an end; the forward recursion sums over every segmentation of a word
in log space. Beside it stands a word-unigram score with add-one smoothing from counts over all training documents.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MARK = "▁".encode()
#: No word holds white space, so the end of a text has a name of its own.
END = b"\n"
#: Mandelbrot's offset of the rank.
OFFSET = 2.7
#: Weight of the vocabulary's own scores, in pieces, against the expected counts.
PRIOR = 1000.0
#: Bytes of text whose words are numbered together.
GATHERED = 8 << 20
#: Words whose lattice is laid out together.
TOGETHER = 20_000


class Vocabulary:
    """Pieces as a byte trie, and their prior. Byte pieces make every word reachable."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, prior, self.byte = {}, np.zeros(model.get_piece_size() + 1), np.zeros(256, dtype=np.int64)
        for k in range(model.get_piece_size()):
            text = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte[int(text[3:-1], 16)] = k
                prior[k] = 1e-7
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k) or "▁" in text[1:]):
                pieces[text.encode()] = k
                prior[k] = 1.0 / (1.0 + OFFSET - model.get_score(k))  # the first rank is 0 here
        self.end = model.get_piece_size()
        prior[self.end] = 1e-2
        self.prior = prior / prior.sum()
        self.opens = np.zeros(len(prior), dtype=bool)
        nodes, edges, token = {b"": 0}, {}, [-1]
        for s, k in pieces.items():
            self.opens[k] = s.startswith(MARK)
            for n in range(1, len(s) + 1):
                if s[:n] not in nodes:
                    nodes[s[:n]] = len(token)
                    edges[nodes[s[: n - 1]] * 256 + s[n - 1]] = len(token)
                    token.append(-1)
            token[nodes[s]] = k
        keys = np.fromiter(edges, dtype=np.int64, count=len(edges))
        order = np.argsort(keys)
        self.edge_keys, self.edge_to, self.token_at = keys[order], np.fromiter(edges.values(), dtype=np.int64, count=len(edges))[order], np.array(token)


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattice:
    """All arcs (start, end, piece) of some words, between nodes: a word of n bytes with its mark has n + 1."""

    def __init__(self, v: Vocabulary, words: list[bytes]):
        text, off = C.joined([MARK + w for w in words])
        n = len(text)
        word = np.repeat(np.arange(len(words)), np.diff(off))
        stop = off[1:][word]
        live, node, depth = np.arange(n), np.zeros(n, dtype=np.int64), 0
        starts, ends, pieces = [np.arange(n)], [np.arange(1, n + 1)], [v.byte[text]]
        while len(live):
            inside = live + depth < stop[live]
            live, node = live[inside], node[inside]
            key = node * 256 + text[live + depth]
            at = np.minimum(np.searchsorted(v.edge_keys, key), len(v.edge_keys) - 1)
            ok = v.edge_keys[at] == key
            live, node = live[ok], v.edge_to[at[ok]]
            depth += 1
            got = v.token_at[node] >= 0
            starts.append(live[got])
            ends.append(live[got] + depth)
            pieces.append(v.token_at[node[got]])
        start, end, piece = (np.concatenate(x) for x in (starts, ends, pieces))
        fine = ~v.opens[piece] | (start == off[:-1][word[np.minimum(start, n - 1)]])
        start, end, piece = start[fine], end[fine], piece[fine]
        self.word = word[start]
        self.from_start = start - off[:-1][self.word]
        self.to_end = end - off[:-1][self.word]
        self.a, self.b, self.piece = start + self.word, end + self.word, piece
        self.first, self.last = off[:-1] + np.arange(len(words)), off[1:] + np.arange(len(words))
        self.nodes = n + len(words)

    @staticmethod
    def _sums(level: np.ndarray, source: np.ndarray, target: np.ndarray, weight: np.ndarray, seeds: np.ndarray, nodes: int) -> np.ndarray:
        out = np.full(nodes, -np.inf)
        out[seeds] = 0.0
        order = np.lexsort((target, level))
        level, source, target, weight = level[order], source[order], target[order], weight[order]
        cuts = np.flatnonzero(np.append(True, level[1:] != level[:-1])).tolist()
        for x, y in zip(cuts, [*cuts[1:], len(level)]):
            values, to = out[source[x:y]] + weight[x:y], target[x:y]
            begin = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            top = np.maximum.reduceat(values, begin)
            out[to[begin]] = top + np.log(np.add.reduceat(np.exp(values - np.repeat(top, np.diff(np.append(begin, y - x)))), begin))
        return out

    def forward(self, logs: np.ndarray) -> np.ndarray:
        return self._sums(self.to_end, self.a, self.b, logs[self.piece], self.first, self.nodes)

    def backward(self, logs: np.ndarray) -> np.ndarray:
        return self._sums(-self.from_start, self.b, self.a, logs[self.piece], self.last, self.nodes)


def _chunks(words: list[bytes]):
    """Index lists of words of like length, each of bounded bytes."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    begin = size = 0
    for n, k in enumerate(order):
        size += len(words[k]) + 8
        if n + 1 - begin == TOGETHER or size > 16 * TOGETHER or n + 1 == len(order):
            yield order[begin : n + 1]
            begin, size = n + 1, 0


def word_logs(v: Vocabulary, words: list[bytes], logs: np.ndarray) -> np.ndarray:
    """The natural log of each word's probability, summed over its segmentations."""
    out = np.zeros(len(words))
    for own in _chunks(words):
        lattice = Lattice(v, [words[k] for k in own])
        out[own] = lattice.forward(logs)[lattice.last]
    return out


def expected_pieces(v: Vocabulary, words: list[bytes], n: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """How often each piece is expected in n occurrences of each word."""
    out = np.zeros(len(v.prior))
    for own in _chunks(words):
        lattice = Lattice(v, [words[k] for k in own])
        ahead, behind = lattice.forward(logs), lattice.backward(logs)
        share = np.exp(ahead[lattice.a] + logs[lattice.piece] + behind[lattice.b] - ahead[lattice.last][lattice.word]) * n[own][lattice.word]
        out += np.bincount(lattice.piece, share, len(out))
    return out


def _logs(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(p)


def fit(counted: DataFrame, path: str, rounds: int = 2) -> np.ndarray:
    """Log weights of the pieces and, last, of the end: expected counts over all training documents, from the prior on,
    taken anew under the last weights in each round. counted has every distinct word once, with its count."""
    prior = vocabulary(path).prior
    logs = _logs(prior)
    for _ in range(rounds):
        shared = counted.sparkSession.sparkContext.broadcast(logs)  # a weight for each piece of the vocabulary

        def expect(batches, shared=shared):
            v = vocabulary(path)
            total = np.zeros(len(v.prior))
            for batch in batches:
                for words, sizes, counts in zip(*(batch.column(c).to_pylist() for c in ("words", "sizes", "counts")), strict=True):
                    ends, c = np.cumsum(np.frombuffer(sizes, "<u4")).tolist(), np.frombuffer(counts, "<i8")
                    own = [(words[a:b], n) for a, b, n in zip([0, *ends], ends, c.tolist()) if n]
                    total[v.end] += sum(n for w, n in own if w == END)
                    own = [x for x in own if x[0] != END]
                    if own:
                        total += expected_pieces(v, [w for w, _ in own], np.array([n for _, n in own], dtype=np.float64), shared.value)
            k = np.flatnonzero(total)
            yield C.batch_of(["piece", "n"], [k, total[k]], [pa.int32(), pa.float64()])

        got = counted.select("words", "sizes", "counts").mapInArrow(C.tidied(expect), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()  # a row for each piece at most
        total = PRIOR * prior
        np.add.at(total, got.column("piece").to_numpy(), got.column("n").to_numpy())
        logs = _logs(total / total.sum())
    return logs


BODY = "kind int, batch long, bucket int, words binary, sizes binary, counts binary, docs binary, tokens binary, owners binary, places binary, times binary"
NAMES = [x.split()[0] for x in BODY.split(", ")]

def score_documents(docs: DataFrame, vocabulary_file: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row for each row of docs, repeated rows
    too (each is learned from); an empty table gives none.

    Null text counts as empty: one token, the end. Texts are read whole. held_out: crc32(doc_id as text) mod 7 is 2; a
    null doc_id is not held out and not learned from. Without training documents the base is uniform and the pieces have
    the vocabulary's weights. Other columns of docs, whatever their names, are not read.
    """
    path = C.vocabulary_path(vocabulary_file)
    spark = docs.sparkSession
    n = C.parts(spark)
    rows = C.texts(docs).withColumn("fold", C.crc_fold(F.col("doc_id"), 7))

    def gather(batches):
        uid, held, size, rows = C.counter(), [], 0, 0
        for batch in batches:
            for piece in C.slices(batch):
                if held and rows + piece.num_rows > 60_000:
                    yield from bodies(pa.Table.from_batches(held).combine_chunks().to_batches()[0], next(uid))
                    held, size, rows = [], 0, 0
                held.append(piece)
                size, rows = size + piece.nbytes, rows + piece.num_rows
                if size >= GATHERED:
                    yield from bodies(pa.Table.from_batches(held).combine_chunks().to_batches()[0], next(uid))
                    held, size, rows = [], 0, 0
        if held:
            yield from bodies(pa.Table.from_batches(held).combine_chunks().to_batches()[0], next(uid))

    def bodies(piece, uid):
        ids: dict = defaultdict()
        ids.default_factory = ids.__len__
        at = [np.array(list(map(ids.__getitem__, [*t.lower().split(), END])), dtype=np.int32) for t in C.raw(piece)]
        tokens = np.fromiter(map(len, at), dtype=np.int64, count=len(at))
        word = np.concatenate(at).astype(np.int64)
        del at
        doc = np.repeat(np.arange(len(tokens)), tokens)
        words = list(ids)
        fold = np.array([-1 if x is None else x for x in piece.column("fold").to_pylist()])
        train = np.bincount(word[((fold >= 0) & (fold != 2))[doc]], minlength=len(words))
        bucket = np.fromiter((zlib.crc32(w) % n for w in words), dtype=np.int64, count=len(words))
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(words), dtype=np.int64)
        place[order] = np.arange(len(words))
        pair, times = np.unique(place[word] * len(tokens) + doc, return_counts=True)
        owner, where = np.divmod(pair, len(tokens))
        many = -(-times // 255)  # a count over 255 takes several entries
        last = np.cumsum(many) - 1
        small = np.full(int(many.sum()), 255, dtype=np.uint8)
        small[last] = times - 255 * (many - 1)
        per_word = np.bincount(np.repeat(owner, many), minlength=len(words)).astype("<u4")
        cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
            own = [words[k] for k in order[a:b].tolist()]
            yield C.batch_of(NAMES, [[0], [uid], [int(bucket[order[a]])], [b"".join(own)], [np.array([len(w) for w in own], dtype="<u4").tobytes()], [train[order[a:b]].astype("<i8").tobytes()], *[[None]] * 5], [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 8])
        docs_ = np.array([x or 0 for x in C.ids(piece)], dtype="<i8").tobytes() + bytes(x is None for x in C.ids(piece)) + bytes((fold == 2).tolist())
        yield C.batch_of(NAMES, [[1], [uid], [-1], [None], [None], [None], [docs_], [tokens.astype("<i8").tobytes()], [per_word.tobytes()], [np.repeat(where, many).astype("<u2").tobytes()], [small.tobytes()]], [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 8])

    def by_bucket(batches, columns):
        """The rows of one bucket at a time; those of a bucket follow each other."""
        held, bucket = [], None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", *columns)), strict=True):
                if row[0] != bucket and held:
                    yield bucket, held
                    held = []
                bucket = row[0]
                held.append(row[1:])
        if held:
            yield bucket, held

    def numbered(rows):
        """The distinct words of (batch, words, sizes, counts) rows, and each row's places among them."""
        ids: dict = defaultdict()
        ids.default_factory = ids.__len__
        lists = []
        for uid, words, sizes, counts in rows:
            ends = np.cumsum(np.frombuffer(sizes, "<u4")).tolist()
            lists.append((uid, np.fromiter(map(ids.__getitem__, [words[a:b] for a, b in zip([0, *ends], ends)]), dtype=np.int64, count=len(ends)), np.frombuffer(counts, "<i8")))
        c = np.zeros(len(ids), dtype=np.int64)
        for _, k, counts in lists:
            np.add.at(c, k, counts)
        return list(ids), c, lists

    def total(batches):
        """Each distinct word of a bucket once, with its count over all training documents."""
        for bucket, rows in by_bucket(batches, ("batch", "words", "sizes", "counts")):
            words, c, _ = numbered(rows)
            for k in range(0, len(words), 100_000):
                own, n_ = words[k : k + 100_000], c[k : k + 100_000]
                yield C.batch_of(["bucket", "words", "sizes", "counts", "distinct", "tokens"], [[bucket], [b"".join(own)], [np.array([len(w) for w in own], dtype="<u4").tobytes()], [n_.astype("<i8").tobytes()], [int((n_ > 0).sum())], [int(n_.sum())]], [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()])

    made = C.materialise(rows.mapInArrow(C.tidied(gather), BODY), "lm-words")
    lists = made.where("kind = 0").select("bucket", "batch", "words", "sizes", "counts").repartition(n, "bucket").sortWithinPartitions("bucket")
    counted = C.materialise(lists.mapInArrow(C.tidied(total), "bucket int, words binary, sizes binary, counts binary, distinct long, tokens long"), "lm-counts")
    distinct, all_tokens = counted.agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    model = spark.sparkContext.broadcast(fit(counted, path))  # a weight for each piece of the vocabulary

    def reply(batches):
        """To each batch the counts and the log probabilities of its own words, in the batch's order."""
        v = vocabulary(path)
        for bucket, rows in by_bucket(batches, ("batch", "words", "sizes", "counts")):
            words, c, lists_ = numbered(rows)
            logs = np.full(len(words), model.value[v.end])
            own = [k for k, w in enumerate(words) if w != END]
            if own:
                logs[own] = word_logs(v, [words[k] for k in own], model.value)
            logs /= np.log(10)
            for uid, k, _ in lists_:
                yield C.batch_of(["batch", "bucket", "counts", "logs"], [[uid], [bucket], [c[k].astype("<i8").tobytes()], [logs[k].astype("<f8").tobytes()]], [pa.int64(), pa.int32(), pa.binary(), pa.binary()])

    def finish(batches):
        """A batch's counts come bucket by bucket, its body last."""
        counts, logs = [], []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "counts", "docs", "tokens", "logs", "owners", "places", "times")), strict=True):
                if row[0] >= 0:
                    counts.append(np.frombuffer(row[1], "<i8"))
                    logs.append(np.frombuffer(row[4], "<f8"))
                    continue
                c, log = np.concatenate(counts), np.concatenate(logs)
                counts, logs = [], []
                tokens = np.frombuffer(row[3], "<i8")
                m = len(tokens)
                ids = np.frombuffer(row[2], "<i8", m).tolist()
                null, held = row[2][8 * m : 9 * m], row[2][9 * m :]
                per_word, where, times = np.frombuffer(row[5], "<u4"), np.frombuffer(row[6], "<u2"), np.frombuffer(row[7], np.uint8).astype(np.float64)
                weight = np.repeat(np.log10((c + 1) / (all_tokens + distinct + 1)), per_word)
                base = np.bincount(where, times * weight, m)
                known = np.bincount(where, times * np.repeat(c > 0, per_word), m).astype(np.int64)
                yield C.batch_of(["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"], [[None if z else d for d, z in zip(ids, null)], [bool(x) for x in held], tokens, known, base, np.bincount(where, times * np.repeat(log, per_word), m)], [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()])

    none = F.lit(None).cast("binary")
    body = made.where("kind = 1").select("batch", "bucket", none.alias("counts"), none.alias("logs"), "docs", "tokens", "owners", "places", "times")
    answers = lists.mapInArrow(C.tidied(reply), "batch long, bucket int, counts binary, logs binary").select("*", *[none.alias(c) for c in ("docs", "tokens", "owners", "places", "times")])
    met = body.unionByName(answers).repartition(n, "batch").sortWithinPartitions("batch", F.col("bucket") < 0, "bucket")
    out = met.mapInArrow(C.tidied(finish), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(all_tokens)).cast("long").alias("train_tokens"), "base_score", "score")
