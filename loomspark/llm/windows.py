"""What substring dedup and suffix-array dedup share: rolling hashes, sketches of repeated keys, packed exchanges, coverage."""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bytes of text that are hashed together: their 64-bit hashes then fit a processor's cache.
PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_BYTES = C.mixed(np.arange(1, 257, dtype=np.uint64))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        have = np.full(n + 1, base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= 2 * C.STEP_BYTES:
            _POWERS[base] = have
    return have[: n + 1]


class Rolling:
    """Hashes of any byte ranges of an array: differences of a prefix sum, brought to a common power."""

    def __init__(self, t: np.ndarray):
        n = len(t)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTES[t] * powers(_BASE, n)[:n], out=self.sums[1:])
        self.back = powers(pow(_BASE, -1, 1 << 64), n)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return C.mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def all(self, k: int) -> np.ndarray:
        """Of every range of k bytes."""
        return C.mixed((self.sums[k:] - self.sums[:-k]) * self.back[: len(self.sums) - k])


def lowest(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values."""
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - have : w - have + len(x) - w + 1])


def once_a_document(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The keys, sorted, with most of what one document has twice left out."""
    order = np.argsort(keys)
    keys, doc = keys[order], doc[order]
    return keys[np.append(True, (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1]))] if len(keys) else keys


class Sketch:
    """A set of well mixed 64-bit keys as bits: each of ROWS hashes sets one, in the part that the key's first bits choose.

    Whoever is in it is found; of others as many as there are cells set, to the power ROWS. Beyond the first 40 bits keys
    are not told apart. 2 ** (bits + 1) cells in all.
    """

    ROWS = 2
    PARTS = 256

    @classmethod
    def width(cls, bits: int) -> int:
        """Bits of a place within a part."""
        return min(32, max(3, bits + 1 - (cls.PARTS - 1).bit_length()))

    @classmethod
    def places(cls, rest: np.ndarray, bits: int, row: int) -> np.ndarray:
        """Within its part, by the 32 bits of a key that follow those of the part."""
        mixed = rest if not row else rest * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)
        return (mixed >> np.uint64(32 - cls.width(bits))).astype(np.int64)

    @staticmethod
    def split(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Part of each key, and the 32 bits that follow."""
        return (keys >> np.uint64(56)).astype(np.int64), keys >> np.uint64(24) & np.uint64(0xFFFFFFFF)

    @classmethod
    def part(cls, rest: np.ndarray, bits: int) -> np.ndarray:
        """The bits of one part that holds these keys."""
        out = np.zeros(1 << cls.width(bits), dtype=bool)
        for row in range(cls.ROWS):
            out[cls.places(rest, bits, row)] = True
        return np.packbits(out, bitorder="little")

    @classmethod
    def repeated(cls, cells: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
        """Whether the cells may hold each key."""
        part, rest = cls.split(keys)
        part <<= cls.width(bits)
        found = np.ones(len(keys), dtype=bool)
        for row in range(cls.ROWS):
            at = part + cls.places(rest, bits, row)
            found &= (cells[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


#: The least and the most bits of a sketch that follows its input: 2 ** (bits + 1) bits are broadcast.
FEWEST, MOST = 20, 29


def expected_bytes(docs: DataFrame) -> int:
    """Bytes that Spark expects docs to have."""
    return int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def fitting_bits(docs: DataFrame) -> int:
    """Bits of a sketch with about one cell for every eight bytes that Spark expects docs to have, between FEWEST and MOST: it
    holds repeated keys only."""
    return min(MOST, max(FEWEST, (expected_bytes(docs) // 16).bit_length()))


def packed_sorted(x: np.ndarray) -> bytes:
    """Sorted unsigned 32-bit integers: their steps, by planes of bytes, compressed."""
    return squeeze(np.diff(x.astype("<u4"), prepend=np.zeros(1, dtype="<u4")).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked_sorted(x: bytes) -> np.ndarray:
    planes = loosen(x, np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1), dtype=np.uint32)


#: Keys of a task that are looked at together, and occurrences among them from which a key counts as common.
UNIT, LEAST = 500_000, 64
#: Common keys that are reported at most, the most frequent ones first, and the parts in which they are summed.
REPORTED, SUMS = 100_000, 64


def repeated_cells(docs: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A sketch of the keys that are met twice, over all documents, and keys that are common in some part of them.

    Keys are counted exactly, whatever their number: each task sends its different keys, 40 bits of each, sorted and packed,
    to the parts that they belong to, and a part holds those alone that several tasks have, or one has twice. The driver gets
    2 ** (bits + 1) bits, and REPORTED keys at most. Which keys are reported only decides how work is spread. A key with a
    share of LEAST / UNIT of all is common in some unit.
    """

    def gather(batches):
        common = Counter()
        held, size = [], 0

        def settle():
            found, n = np.unique(np.concatenate(held), return_counts=True)
            some = n >= LEAST
            common.update(dict(zip(found[some].tolist(), n[some].tolist(), strict=True)))
            part, rest = Sketch.split(found)
            cuts = np.searchsorted(part, np.arange(Sketch.PARTS + 1))
            out = [(k, packed_sorted(rest[x:y][n[x:y] == 1]), packed_sorted(rest[x:y][n[x:y] > 1])) for k, (x, y) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if y > x]
            return C.batch_of(["slice", "once", "twice"], [list(x) for x in zip(*out, strict=True)] or [[], [], []], [pa.int32(), pa.binary(), pa.binary()])

        for batch in batches:
            for piece in C.slices(batch, PIECE):
                held.append(keys(piece))
                size += len(held[-1])
                if size > UNIT:
                    yield settle()
                    held, size = [], 0
        if held:
            yield settle()
        found = np.array(list(common), dtype="<u8")
        times, part = np.array(list(common.values()), dtype="<u8"), found % np.uint64(SUMS)
        for k in np.unique(part).tolist():
            own_part = part == k
            yield C.batch_of(["slice", "once", "twice"], [[-1 - k], [found[own_part].tobytes()], [times[own_part].tobytes()]], [pa.int32(), pa.binary(), pa.binary()])

    def merge(batches):
        held: list[np.ndarray] = []
        current: int | None = None
        common: dict[int, Counter] = {}

        def close():
            own, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return C.batch_of(["slice", "twice"], [[current], [zlib.compress(Sketch.part(own[n > 1].astype(np.uint64), bits).tobytes(), 1)]], [pa.int32(), pa.binary()])

        for batch in batches:
            for k, once, twice in zip(*(batch.column(c).to_pylist() for c in ("slice", "once", "twice")), strict=True):
                if k < 0:
                    sums = common.setdefault(k, Counter())
                    for key, n in zip(np.frombuffer(once, "<u8").tolist(), np.frombuffer(twice, "<u8").tolist(), strict=True):
                        sums[key] += n
                    if len(sums) > 4 * REPORTED:
                        common[k] = Counter(dict(sums.most_common(REPORTED)))
                    continue
                if k != current and held:
                    yield close()
                current = k
                again = unpacked_sorted(twice)
                held += [unpacked_sorted(once), again, again]
        if held:
            yield close()
        for k, sums in common.items():
            top = sorted(sums, key=lambda x: (-sums[x], x))[: -(-REPORTED // SUMS)]  # noqa: B023
            yield C.batch_of(["slice", "twice"], [[k], [np.array(top, dtype="<u8").tobytes()]], [pa.int32(), pa.binary()])

    merged = docs.mapInArrow(C.tidied(gather), "slice int, once binary, twice binary").repartition(C.parts(docs.sparkSession), "slice").sortWithinPartitions("slice").mapInArrow(C.tidied(merge), "slice int, twice binary")
    size = 1 << (Sketch.width(bits) - 3)
    out = np.zeros(Sketch.PARTS * size, dtype=np.uint8)
    often = [np.empty(0, dtype=np.uint64)]
    for row in merged.collect():  # compressed bits, as many as the sketch has, and REPORTED keys
        if row[0] < 0:
            often.append(np.frombuffer(bytes(row[1]), "<u8"))
        else:
            out[row[0] * size : (row[0] + 1) * size] = np.frombuffer(zlib.decompress(bytes(row[1])), dtype=np.uint8)
    return out, np.sort(np.concatenate(often))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key: rows alike in both are alike in every result; a null doc_id is no smaller than any."""
    return C.texts(docs).withColumn("key", F.hash("doc_id", "text").cast("long"))


@functools.cache
def _squeezer(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level)


@functools.cache
def _loosener() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def squeeze(x: np.ndarray | bytes, level: int | None = None) -> bytes:
    """What goes over the wire in one value: compressed, since ids, places and texts there repeat a lot."""
    return _squeezer(level or (3 if isinstance(x, bytes) else 1)).compress(x if isinstance(x, bytes) else x.tobytes())


def loosen(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(_loosener().decompress(x), kind)


#: Removed windows on their way back: for a bucket of documents, the document, its key, first window and length of runs.
SPANS = "bucket int, docs binary, keys binary, starts binary, lens binary"
SPAN_NAMES = ["bucket", "docs", "keys", "starts", "lens"]


def document_buckets(doc: np.ndarray, n: int) -> np.ndarray:
    return (C.mixed(doc.view(np.uint64)) % np.uint64(n)).astype(np.int64)


def packed_spans(doc: np.ndarray, key: np.ndarray, start: np.ndarray, length: np.ndarray, n: int) -> Iterator[tuple]:
    """Rows of SPANS; runs that touch become one."""
    if not len(doc):
        return
    order = np.lexsort((start, key, doc))
    doc, key, start, length = (x[order] for x in (doc, key, start, length))
    same = (doc[1:] == doc[:-1]) & (key[1:] == key[:-1])
    fresh = np.append(True, ~(same & (start[1:] <= start[:-1] + length[:-1])))
    first = np.flatnonzero(fresh)
    end = np.maximum.reduceat(start + length, first)  # within a run of touching neighbours
    doc, key, start = doc[first], key[first], start[first]
    bucket = document_buckets(doc, n)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
    for a, b in zip(cuts, np.append(cuts[1:], len(order))):
        k = order[a:b]
        yield int(bucket[k[0]]), squeeze(doc[k].astype("<i8")), squeeze(key[k].astype("<i4")), squeeze(start[k].astype("<u4")), squeeze((end - start)[k].astype("<u4"))


def span_batch(rows: list[tuple]) -> pa.RecordBatch:
    return C.batch_of(SPAN_NAMES, [list(x) for x in zip(*rows, strict=True)], [pa.int32()] + [pa.binary()] * 4)


class Outbox:
    """Gathers removed runs of a task, so that few rows of SPANS leave it."""

    FULL = 1_000_000

    def __init__(self, n: int):
        self.n, self.held, self.size = n, [], 0

    def add(self, doc: np.ndarray, key: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        if len(doc):
            self.held.append((doc, key, start, length))
            self.size += len(doc)

    def full(self):
        if self.size >= self.FULL:
            yield from self.rest()

    def rest(self):
        if self.held:
            rows = list(packed_spans(*(np.concatenate(x) for x in zip(*self.held, strict=True)), self.n))
            self.held, self.size = [], 0
            yield span_batch(rows)


def runs_by_document(spans: DataFrame) -> DataFrame:
    """doc_id, key, starts, lens: the removed runs of windows of each document that has any, from rows of SPANS."""

    def run(batches):
        held, bucket = [], None

        def close():
            doc, key, start, length = (np.concatenate([loosen(h[k], kind) for h in held]).astype(np.int64) for k, kind in enumerate(("<i8", "<i4", "<u4", "<u4")))
            order = np.lexsort((start, key, doc))
            doc, key, start, length = (x[order] for x in (doc, key, start, length))
            cuts = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))
            ends = np.append(cuts[1:], len(doc))
            return C.batch_of(["doc_id", "key", "starts", "lens"], [doc[cuts], key[cuts], [start[a:b].astype("<u4").tobytes() for a, b in zip(cuts, ends)], [length[a:b].astype("<u4").tobytes() for a, b in zip(cuts, ends)]], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in SPAN_NAMES), strict=True):
                if row[0] != bucket and held:
                    yield close()
                    held = []
                bucket = row[0]
                held.append(row[1:])
        if held:
            yield close()

    n = C.parts(spans.sparkSession)
    return spans.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(C.tidied(run), "doc_id long, key long, starts binary, lens binary")


def covered(starts: bytes | None, lens: bytes | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The disjoint stretches (start, end) that the windows of the runs cover."""
    if not starts:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    a = np.frombuffer(starts, "<u4").astype(np.int64)
    e = np.maximum.accumulate(a + np.frombuffer(lens, "<u4").astype(np.int64) + width - 1)
    fresh = np.append(True, a[1:] > e[:-1])
    return a[fresh], e[np.append(np.flatnonzero(fresh)[1:] - 1, len(e) - 1)]
