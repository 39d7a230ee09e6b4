"""Exact dedup with a cuckoo-filter index.

Each task first files its own rows in an index, where a hit is verified against the text that the bucket stands for, so
a text that a third of all rows share leaves a task as a few rows. Then the tasks' live digests meet, dealt by digest,
in a second index, whose buckets hold SHA-256 and length of each text; those decide there.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C


class CuckooIndex:
    """Live digests with a value each. A bucket's four slots hold 16-bit prints beside the stored digests.

    A print that matches is only a hint: the digest stored in that slot decides, and behind it what the value stands for. When an insertion finds no place after
    `kicks` moves, the table doubles and the stored digests are filed again, so no digest is ever lost.
    """

    SLOTS = 4

    def __init__(self, buckets: int = 256, kicks: int = 200):
        self.kicks, self.size = kicks, 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = [0] * (buckets * self.SLOTS)
        self.keys: list[bytes | None] = [None] * (buckets * self.SLOTS)
        self.values: list = [None] * (buckets * self.SLOTS)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        one = int.from_bytes(digest[2:8], "little") & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995 >> 3)) & self.mask

    def _slot(self, digest: bytes) -> int:
        mark, one, two = self._places(digest)
        prints, keys = self.prints, self.keys
        for bucket in (one, two):
            for slot in range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS):
                if prints[slot] == mark and keys[slot] == digest:
                    return slot
        return -1

    def get(self, digest: bytes):
        slot = self._slot(digest)
        return None if slot < 0 else self.values[slot]

    def insert(self, digest: bytes, value) -> None:
        """digest must not be live."""
        mark, bucket, other = self._places(digest)
        for b in (bucket, other):
            for slot in range(b * self.SLOTS, (b + 1) * self.SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.keys[slot], self.values[slot] = mark, digest, value
                    self.size += 1
                    return
        for kick in range(self.kicks):
            slot = bucket * self.SLOTS + (mark + kick) % self.SLOTS
            mark, self.prints[slot] = self.prints[slot], mark
            digest, self.keys[slot] = self.keys[slot], digest
            value, self.values[slot] = self.values[slot], value
            bucket = self._other(bucket, mark)
            for slot in range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.keys[slot], self.values[slot] = mark, digest, value
                    self.size += 1
                    return
        live = [*self.items(), (digest, value)]
        self.size = 0
        self._clear((self.mask + 1) * 2)
        for k, v in live:
            self.insert(k, v)

    def delete(self, digest: bytes) -> bool:
        slot = self._slot(digest)
        if slot < 0:
            return False
        self.prints[slot], self.keys[slot], self.values[slot] = 0, None, None
        self.size -= 1
        return True

    def items(self):
        return [(k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None]


LOCAL = "digest binary, batch long, top long, n long, ids array<long>"
#: Rows of one text in one row of LOCAL.
MOST_IDS = 10_000
#: Bytes of different texts, and rows, that a task's index stands for at most; then it leaves and a new one begins.
MOST_BYTES, MOST_ROWS = 16 << 20, 100_000


def _local(batches):
    """Files a task's rows; every distinct text leaves the index once (a very common one in rows of MOST_IDS ids)."""
    uid = C.counter()
    index, groups, size, rows = CuckooIndex(), [], 0, 0

    def leave():
        for _, docs, _ in groups:
            docs.sort(key=lambda d: (d is not None, d or 0), reverse=True)
        return C.batch_of(["digest", "batch", "top", "n", "ids"], [[g[0] for g in groups], [next(uid) for _ in groups], [g[1][0] for g in groups], [len(g[1]) for g in groups], [g[1] for g in groups]], [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())])

    for batch in batches:
        for piece in C.slices(batch):
            for doc, text in zip(C.ids(piece), C.raw(piece), strict=True):
                digest = hashlib.sha256(text).digest() + len(text).to_bytes(8, "big")
                at = index.get(digest)
                if at is not None and groups[at][2] != text:
                    raise ValueError("two texts of one length and SHA-256")
                if at is None or len(groups[at][1]) >= MOST_IDS:
                    if at is not None:  # the full group is no longer live
                        index.delete(digest)
                    index.insert(digest, len(groups))
                    groups.append((digest, [doc], text))
                    size += len(text)
                else:
                    groups[at][1].append(doc)
                rows += 1
            if size >= MOST_BYTES or rows >= MOST_ROWS:
                yield leave()
                index, groups, size, rows = CuckooIndex(), [], 0, 0
    if groups:
        yield leave()


def _global(batches):
    """The live digests of a partition: a later row with a larger id deletes the digest's entry and takes its place."""
    index = CuckooIndex()
    for batch in batches:
        for digest, uid, top, n in zip(*(batch.column(c).to_pylist() for c in ("digest", "batch", "top", "n")), strict=True):
            rank, old = (top is not None, top or 0, uid), index.get(digest)
            if old is None:
                index.insert(digest, (rank, n))
            else:
                index.delete(digest)
                index.insert(digest, (max(rank, old[0]), n + old[1]))
    found = index.items()
    for k in range(0, len(found), 20_000):
        some = found[k : k + 20_000]
        yield C.batch_of(["digest", "keep_id", "keep_batch", "group_size"], [[d for d, _ in some], [r[1] if r[0] else None for _, (r, _) in some], [r[2] for _, (r, _) in some], [n for _, (_, n) in some]], [pa.binary(), pa.int64(), pa.int64(), pa.int64()])


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs.

    Null text counts as empty. Of equal texts the row with the largest doc_id stays; a null doc_id ranks below all
    others; of rows that repeat both text and doc_id exactly one stays. An empty table gives an empty result. Other
    columns of docs, whatever their names, are not read.
    """
    n = C.parts(docs.sparkSession)
    local = C.materialise(C.texts(docs).mapInArrow(C.tidied(_local), LOCAL), "exact")
    live = local.select("digest", "batch", "top", "n").repartition(n, "digest").mapInArrow(C.tidied(_global), "digest binary, keep_id long, keep_batch long, group_size long")
    return local.join(live, "digest").select("*", F.posexplode("ids").alias("at", "doc_id")).select(
        "doc_id",
        "keep_id",
        "group_size",
        ((F.col("batch") == F.col("keep_batch")) & (F.col("at") == 0)).alias("kept"),
        F.lower(F.hex(F.substring("digest", 1, 32))).alias("text_sha256"),
    )


def keep_one_of_equal(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with their columns under any names; of rows that repeat id and text one.

    Nulls, ties and empty tables: see there.
    Rows meet by id and digest, so a text that very many share is spread over as many keys as it has ids.
    """
    row, mark, n = C.spare_names(docs, "row", "mark", "n")
    name = lambda doc, sha: F.concat_ws(":", F.coalesce(doc.cast("string"), F.lit("-")), sha)
    kept = exact_dedup(docs).where("kept").select(name(F.col("doc_id"), F.col("text_sha256")).alias(mark))
    sha = F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary"), 256)
    own = docs.withColumn(row, name(docs["doc_id"].cast("long"), sha))
    joined = own.join(kept, F.col(row) == F.col(mark), "left_semi")
    once = F.row_number().over(W.partitionBy(row).orderBy(row))
    return joined.withColumn(n, once).where(F.col(n) == 1).drop(n, row)
