"""Substring dedup on words: a prefilter of repeated anchors, then exact grouping of the windows that pass it.

A window of `width` words is counted by its anchor, the smallest hash among its five-word parts: a part is in at least
as many documents as any window around it, so the estimate is never below the window's count, and a document has far
fewer anchors than windows. The second pass groups only windows whose anchor may be in two documents, by two hashes of
64 bits each that share no step: a chain of bijective mixes over the bytes of each word, then over the words. Words of
up to eight bytes never share a hash; any two others do in one of 2 ** 128 pairs. Windows that a task itself meets twice
are settled there, so a passage that very many documents share leaves a task once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import common as C
from . import windows as V

#: Words of the parts that anchors are chosen from.
PART = 5
#: Windows of a task that are grouped and handed on together.
GATHERED = 200_000
#: Words of more bytes are hashed one by one.
LONG = 256
#: Starts and factors of the two hashes.
LANES = ((0x243F6A8885A308D3, 0x9E3779B97F4A7C15), (0x13198A2E03707344, 0xD6E8FEB86659FD93))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def word_hashes(t: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each word: eight bytes a step, for all words that have as many."""
    n = ends - starts
    padded = np.concatenate([t, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(len(t) + 1, dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    out = [np.full(len(n), seed, dtype=np.uint64) for seed, _ in LANES]
    live, done = np.flatnonzero(n <= LONG), 0
    while len(live):
        left = np.minimum(n[live] - done, 8).astype(np.uint64)
        block = eight[starts[live] + done] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
        for h, (_, factor) in zip(out, LANES, strict=True):
            h[live] = C.mixed((h[live] + np.uint64(done)) * np.uint64(factor) ^ block)
        done += 8
        live = live[n[live] > done]
    for k in np.flatnonzero(n > LONG).tolist():
        digest = xxhash.xxh3_128_digest(t[starts[k] : ends[k]].tobytes())
        for h, half in zip(out, (digest[:8], digest[8:]), strict=True):
            h[k] = int.from_bytes(half, "little")
    return [C.mixed(h + n.astype(np.uint64) * np.uint64(factor)) for h, (_, factor) in zip(out, LANES, strict=True)]


class Words:
    """Word hashes of a piece's documents."""

    def __init__(self, chunks: list[bytes]):
        t, off = C.joined([c + b" " for c in chunks])
        blank = _SPACE[t]
        starts = np.flatnonzero(~blank & np.append(True, blank[:-1])) if len(t) else np.empty(0, dtype=np.int64)
        ends = np.flatnonzero(blank & np.append(False, ~blank[:-1])) if len(t) else starts
        self.lanes = word_hashes(t, starts, ends)
        self.doc = np.searchsorted(off, starts, side="right") - 1
        self.counts = np.bincount(self.doc, minlength=len(chunks))

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (in the piece) of all windows, and their anchors."""
        n = len(self.doc)
        if n < width:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        part = min(PART, width)
        anchors = C.mixed(V.lowest(self.chained(0, np.arange(n - part + 1), part), width - part + 1))
        at = np.flatnonzero(self.doc[: n - width + 1] == self.doc[width - 1 :])
        return at, anchors[at]

    def chained(self, lane: int, at: np.ndarray, n: int) -> np.ndarray:
        """A hash of the n words from each place on."""
        h, (seed, factor) = self.lanes[lane], LANES[lane]
        out = np.full(len(at), seed, dtype=np.uint64)
        for k in range(n):
            out = C.mixed(out * np.uint64(factor) + h[at + k])
        return out


ENTRIES = "bucket int, h1 binary, h2 binary, row binary, pos binary, docs binary, keys binary, starts binary, lens binary"
ENTRY_NAMES = ["bucket", "h1", "h2", "row", "pos", "docs", "keys", "starts", "lens"]


def _split(x: list[np.ndarray]):
    return [np.concatenate(c) for c in zip(*x, strict=True)]


def word_window_dedup(docs: DataFrame, width: int = 13, sketch_bits: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text, one row for each row of docs.

    Removed is each word in a window of `width` words whose sequence also starts in a document with a smaller doc_id.
    Null text has no words; a document of fewer words than a window keeps all; rows with a null doc_id keep all and
    remove nothing. Rows that repeat a doc_id do not remove from each other; an empty table gives an empty result.
    Long texts are hashed in pieces of their own. Other columns of docs, whatever their names, are not read.
    sketch_bits sets the prefilter's size (2 ** (sketch_bits + 1) bits broadcast; by default it follows the input, see
    windows.fitting_bits) and speed, never the result.
    """
    spark = docs.sparkSession
    rows = V.keyed(docs)
    read = rows.where("doc_id is not null and text is not null")
    sketch_bits = sketch_bits or V.fitting_bits(docs)

    def anchors(piece):
        w = Words(C.raw(piece))
        at, keys = w.windows(width)
        return V.once_a_document(keys, w.doc[at])

    twice = spark.sparkContext.broadcast(V.repeated_cells(read.select("text"), anchors, sketch_bits)[0])
    n = C.parts(spark)

    def gather(batches):
        held, size = [], 0

        def flush():
            doc, key, pos, h1, h2 = _split(held)
            order = np.lexsort((doc, h2, h1))
            doc, key, pos, h1, h2 = (x[order] for x in (doc, key, pos, h1, h2))
            fresh = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
            first = doc[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
            later = doc > first  # settled here
            out = [(-1 - s[0], *[None] * 4, *s[1:]) for s in V.packed_spans(doc[later], key[later], pos[later], np.ones(int(later.sum()), dtype=np.int64), n)]
            doc, key, pos, h1, h2 = (x[~later] for x in (doc, key, pos, h1, h2))
            bucket = (h1 >> np.uint64(40)).astype(np.int64) % n
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else []
            for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
                k = order[a:b]
                own, row = np.unique(np.stack([doc[k], key[k]]), axis=1, return_inverse=True)
                out.append((int(bucket[k[0]]), h1[k].tobytes(), h2[k].tobytes(), V.squeeze(row.astype("<u4")), V.squeeze(pos[k].astype("<u4")), V.squeeze(own[0].astype("<i8")), V.squeeze(own[1].astype("<i4")), None, None))
            held.clear()
            return C.batch_of(ENTRY_NAMES, [list(x) for x in zip(*out, strict=True)], [pa.int32()] + [pa.binary()] * 8)

        for batch in batches:
            for piece in C.slices(batch, V.PIECE):
                w = Words(C.raw(piece))
                at, keys = w.windows(width)
                some = V.Sketch.repeated(twice.value, sketch_bits, keys)
                at = at[some]
                if not len(at):
                    continue
                begin = np.cumsum(w.counts) - w.counts
                doc = piece.column("doc_id").to_numpy(zero_copy_only=False)
                key = piece.column("key").to_numpy(zero_copy_only=False)
                d = w.doc[at]
                held.append((doc[d], key[d], at - begin[d], w.chained(0, at, width), w.chained(1, at, width)))
                size += len(at)
                if size >= GATHERED:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def settle(batches):
        held, bucket, out = [], None, V.Outbox(n)

        def close():
            cols = []
            for h1, h2, row, pos, own, keys in held:
                row = V.loosen(row, "<u4")
                cols.append((V.loosen(own, "<i8")[row], V.loosen(keys, "<i4").astype(np.int64)[row], V.loosen(pos, "<u4").astype(np.int64), np.frombuffer(h1, "<u8"), np.frombuffer(h2, "<u8")))
            doc, key, pos, h1, h2 = _split(cols)
            held.clear()
            order = np.lexsort((doc, h2, h1))
            doc, h1, h2 = doc[order], h1[order], h2[order]
            fresh = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
            later = doc > doc[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
            k = order[later]
            out.add(doc[later], key[k], pos[k], np.ones(len(k), dtype=np.int64))

        for batch in batches:
            passed = []
            for row in zip(*(batch.column(c).to_pylist() for c in ENTRY_NAMES), strict=True):
                if row[0] < 0:
                    passed.append((-1 - row[0], *row[5:]))
                    continue
                if row[0] != bucket and held:
                    close()
                bucket = row[0]
                held.append(row[1:7])
            if passed:
                yield V.span_batch(passed)
            yield from out.full()
        if held:
            close()
        yield from out.rest()

    spans = read.mapInArrow(C.tidied(gather), ENTRIES).repartition(C.parts(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(C.tidied(settle), V.SPANS)
    runs = V.runs_by_document(spans)

    def keep(piece):
        out = []
        for text, starts, lens in zip(C.raw(piece), piece.column("starts").to_pylist(), piece.column("lens").to_pylist(), strict=True):
            words = text.split()
            n_words = len(words)
            a, e = V.covered(starts, lens, width)
            for x, y in zip(a[::-1].tolist(), e[::-1].tolist(), strict=True):
                del words[x:y]
            kept = b" ".join(words)
            out.append((n_words, n_words - len(words), hashlib.sha256(kept).hexdigest(), kept))
        return C.batch_of(["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"], [C.ids(piece), *[list(x) for x in zip(*out, strict=True)]], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()])

    joined = rows.join(runs, ["doc_id", "key"], "left")
    return C.map_slices(joined, keep, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
