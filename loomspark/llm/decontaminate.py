"""Benchmark decontamination by Wu-Manber search for windows of benchmark words."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Lower-cases A-Z and makes every other ASCII byte that is no letter or digit a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def folded(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class WuManber:
    """Finds all occurrences of many byte patterns (three bytes each at least) in a byte array.

    Patterns of like length form a class. For a class with shortest pattern m and blocks of B bytes, `shift` tells for
    the block that ends at a text position how far the search may move on; where it is zero, the bucket of patterns
    whose m-th byte ends that block is compared directly. Many cursors, one for each stretch of text, move at once.
    """

    CLASSES = (8, 16, 32, 1 << 62)
    STRETCH = 1024

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.classes = []
        low = 0
        for high in self.CLASSES:
            own = [k for k, p in enumerate(patterns) if low <= len(p) < high]
            low = high
            if own:
                self.classes.append(self._tables(own))

    @staticmethod
    def _code(t: np.ndarray, end: np.ndarray, block: int, bits: int) -> np.ndarray:
        """A hash of the `block` bytes that end at each of `end`."""
        code = t[end].astype(np.uint64)
        for k in range(1, block):
            code = code << np.uint64(8) | t[end - k]
        return (code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)

    def _tables(self, own: list[int]):
        m = min(len(self.patterns[k]) for k in own)
        block = 2 if m < 8 else 4 if m < 16 else 8
        bits = max(16, min(24, (4 * m * len(own)).bit_length()))  # sparse, so that most blocks of a text are in no pattern
        heads = np.frombuffer(b"".join(self.patterns[k][:m] for k in own), dtype=np.uint8).reshape(len(own), m)
        shift = np.full(1 << bits, m - block + 1, dtype=np.uint8 if m < 256 else np.int32)
        for j in range(block - 1, m):
            codes = self._code(heads.reshape(-1), np.arange(len(own)) * m + j, block, bits)
            np.minimum.at(shift, codes, m - 1 - j)
        order = np.argsort(codes, kind="stable")  # of the last blocks
        buckets, start = np.unique(codes[order], return_index=True)
        bounds = np.append(start, len(order))
        members = np.asarray(own, dtype=np.int64)[order]
        prefix = heads[order, :3].astype(np.int64) @ np.array([65536, 256, 1])
        return m, block, bits, shift, buckets, bounds, members, prefix

    def search(self, text: bytes) -> list[tuple[int, int]]:
        """(start, pattern) of every occurrence."""
        t, found = np.frombuffer(text, dtype=np.uint8), []
        for m, block, bits, shift, buckets, bounds, members, prefix in self.classes:
            if len(t) < m:
                continue
            cursor = np.arange(m - 1, len(t), self.STRETCH, dtype=np.int64)
            stop = np.minimum(cursor + self.STRETCH, len(t))
            while len(cursor):
                code = self._code(t, cursor, block, bits)
                step = shift[code]
                hit = np.flatnonzero(step == 0)
                for k in range(0, len(hit), 4096):
                    self._compare(text, t, cursor[hit[k : k + 4096]] - (m - 1), code[hit[k : k + 4096]], buckets, bounds, members, prefix, found)
                cursor = cursor + np.maximum(step, 1)
                going = cursor < stop
                if not going.all():
                    cursor, stop = cursor[going], stop[going]
        return found

    def _compare(self, text, t, begin, code, buckets, bounds, members, prefix, found) -> None:
        """Tests the patterns of the bucket at each place: the first bytes, then all."""
        k = np.searchsorted(buckets, code)
        n = bounds[k + 1] - bounds[k]
        at, begin = C.ranges(bounds[k], n), np.repeat(begin, n)
        same = (t[begin].astype(np.int64) << 16 | t[begin + 1].astype(np.int64) << 8 | t[begin + 2]) == prefix[at]
        for b, p in zip(begin[same].tolist(), members[at[same]].tolist(), strict=True):
            if text.startswith(self.patterns[p], b):
                found.append((b, p))


def windows(items: list[tuple[int, bytes]], width: int) -> dict[bytes, list[int]]:
    """Each distinct window, with a space at both ends, and the items that have it."""
    out: dict[bytes, set] = defaultdict(set)
    for item, text in items:
        w = folded(text or b"")
        for k in range(max(1, len(w) - width + 1) if w else 0):
            out[b" " + b" ".join(w[k : k + width]) + b" "].add(item)
    return {k: sorted(v) for k, v in out.items()}


#: Bytes of item texts after which a block ends.
BLOCK_BYTES = 16 << 20


def benchmark_blocks(benchmark: DataFrame, width: int, block_items: int):
    """The stated test set, a block at a time: the driver holds one block, which is bounded in items and in bytes."""
    # null item_ids cannot be named in a result
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("binary")).toLocalIterator()
    some, size, made = [], 0, 0
    for r in rows:
        some.append((r[0], bytes(r[1])))
        size += len(r[1])
        if len(some) == block_items or size >= BLOCK_BYTES:
            yield windows(some, width)
            some, size, made = [], 0, made + 1
    if some or not made:
        yield windows(some, width)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_items: int = 20_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (the sorted item ids), for each row of docs.

    A document word inside any occurrence of a window (`width` consecutive words of an item, or a shorter item whole)
    is hit. Null or empty texts have no words and no hits; items without words or without item_id match nothing;
    repeated items and rows count as they stand; an empty table gives an empty result, an empty benchmark no hits. Texts
    are read whole. Other columns of either table, whatever their names, are not read. The benchmark is searched in
    blocks of block_items items, or of BLOCK_BYTES bytes.
    """
    spark = docs.sparkSession
    out = C.texts(docs).withColumns({"hits": F.lit(None).cast("binary"), "found": F.lit(None).cast("array<long>"), "n_words": F.lit(0).cast("long")})
    schema = "doc_id long, text string, hits binary, found array<long>, n_words long"
    for block in benchmark_blocks(benchmark, width, block_items):
        shared = spark.sparkContext.broadcast(block)

        def search(piece: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            machine, items = _machine(shared)
            words = [folded(x) for x in C.raw(piece)]
            chunks = [b" " + b" ".join(w) + b" " for w in words]
            hits = [np.unpackbits(np.frombuffer(h, dtype=np.uint8))[: len(w)] if h else np.zeros(len(w), dtype=np.uint8) for h, w in zip(piece.column("hits").to_pylist(), words, strict=True)]
            found = [set(f or ()) for f in piece.column("found").to_pylist()]
            starts = np.cumsum([0] + [len(c) + 1 for c in chunks])
            text = b"\n".join(chunks)  # no pattern holds a line end
            spots = machine.search(text)
            if spots:
                spaces = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32)
                begin = np.array([b for b, _ in spots], dtype=np.int64)
                doc = np.searchsorted(starts, begin, side="right") - 1
                word = np.searchsorted(spaces, begin) - np.searchsorted(spaces, starts[doc])
                for d, w, (_, k) in zip(doc.tolist(), word.tolist(), spots, strict=True):
                    hits[d][w : w + items[k][1]] = 1
                    found[d].update(items[k][0])
            return C.batch_of(["doc_id", "text", "hits", "found", "n_words"], [C.ids(piece), piece.column("text"), [np.packbits(h).tobytes() if h.any() else None for h in hits], [sorted(f) for f in found], [len(w) for w in words]], [pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.int64()])

        out = C.map_slices(out, search, schema)
    names = F.array_join(F.array_sort(F.transform("found", lambda x: x.cast("string"))), ",")
    return out.select("doc_id", "n_words", _ones(F.col("hits")).alias("n_hit"), F.size("found").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), F.col("hits").isNotNull().alias("contaminated"), F.col("found").alias("items"))


def _ones(bits):
    """Bits set in a binary: digits of its hexadecimal form, weighted."""
    form = F.hex(bits)
    total = sum((n * F.length(F.regexp_replace(form, f"[^{digits}]", "")) for n, digits in ((1, "1248"), (2, "3569AC"), (3, "7BDE"), (4, "F"))), F.lit(0))
    return F.coalesce(total.cast("long"), F.lit(0).cast("long"))


_MACHINES: dict = {}


def _machine(shared):
    """Built once a worker and block."""
    key = id(shared.value)
    if key not in _MACHINES:
        _MACHINES.clear()
        block = shared.value
        _MACHINES[key] = (WuManber(list(block)), [(v, len(k.split())) for k, v in block.items()], block)
    return _MACHINES[key][:2]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_items: int = 20_000) -> DataFrame:
    """The rows of docs without a hit, with all their columns under any names: a pass for each block, nothing is dealt out.

    Null and empty texts have no words and stay; repeated rows stay or go together; an empty table stays empty.
    """
    C.small_batches(docs.sparkSession)
    out = docs
    for block in benchmark_blocks(benchmark, width, block_items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches, shared=shared):
            for piece in C.pieces(batches):
                machine, _ = _machine(shared)
                chunks = [b" " + b" ".join(folded(x)) + b" " for x in C.raw(piece)]
                starts = np.cumsum([0] + [len(c) + 1 for c in chunks])
                keep = np.ones(len(chunks), dtype=bool)
                for b, _ in machine.search(b"\n".join(chunks)):
                    keep[np.searchsorted(starts, b, side="right") - 1] = False
                yield piece.filter(pa.array(keep))

        out = out.mapInArrow(C.tidied(clean), docs.schema)
    return out
