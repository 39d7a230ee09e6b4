"""Token-id files: fixed-width bit packing with block offsets.

A file holds the ids of consecutive documents. Each id takes the fewest bits that the vocabulary needs; ids are packed
in blocks of `BLOCK` ids, each of which starts at a byte the header lists, so any id can be read without those before
it. Files are the rows of a table in a shared folder: Spark's writer commits them whole, on any store.

Layout, all integers little-endian: magic 8 bytes; then as unsigned 64-bit: bits, block, n_docs, n_ids, n_blocks;
doc ids (n_docs signed 64-bit); a null mask (n_docs bytes); document ends (n_docs unsigned 64-bit, in ids);
block starts (n_blocks + 1 unsigned 64-bit, in bytes of the payload); payload.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C

MAGIC = b"LOOMTOK1"
#: str.split() also parts at these four; the tokenizer does not.
ODD = re.compile("[\x1c-\x1f]")
CHUNK = re.compile(r"(?:[^\s]|[\x1c-\x1f])+")
BLOCK = 4096
#: Where a null doc_id stands in the order of ids.
NULL_FIRST = np.iinfo(np.int64).min
#: Ids after which a file ends.
FILE_IDS = 1 << 19


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(values: np.ndarray, bits: int) -> bytes:
    """The low `bits` bits of each value, one after the other."""
    if not len(values):
        return b""
    wide = np.ascontiguousarray(values, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:  # whole bytes
        return wide[:, : bits // 8].tobytes()
    return np.packbits(np.unpackbits(wide, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes()


def unpack(payload: np.ndarray, first: int, count: int, bits: int) -> np.ndarray:
    """`count` values from bit first * bits on: each is cut out of the eight bytes at its place."""
    if not count:
        return np.empty(0, dtype=np.uint32)
    if bits % 8 == 0:
        wide = np.zeros((count, 4), dtype=np.uint8)
        wide[:, : bits // 8] = payload[first * bits // 8 : (first + count) * bits // 8].reshape(count, -1)
        return wide.view("<u4").reshape(-1)
    at = (first + np.arange(count, dtype=np.int64)) * bits
    low = int(at[0] >> 3)
    data = np.concatenate([payload[low : int(at[-1] >> 3) + 8], np.zeros(8, dtype=np.uint8)])
    byte = (at >> 3) - low
    word = np.zeros(count, dtype=np.uint64)
    for k in range((bits + 14) // 8):
        word |= data[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def write_file(docs: list[int | None], ids: list[np.ndarray], bits: int) -> bytes:
    flat = np.concatenate([*ids, np.empty(0, dtype=np.uint32)]).astype(np.uint32)
    ends = np.cumsum([len(x) for x in ids], dtype=np.uint64)
    blocks = [pack(flat[k : k + BLOCK], bits) for k in range(0, len(flat), BLOCK)]
    starts = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    head = np.array([bits, BLOCK, len(docs), len(flat), len(blocks)], dtype="<u8")
    return b"".join([MAGIC, head.tobytes(), np.array([d or 0 for d in docs], dtype="<i8").tobytes(), bytes(d is None for d in docs), ends.astype("<u8").tobytes(), starts.tobytes(), *blocks])


class TokenFile:
    """Reads a file's documents, all or any."""

    def __init__(self, content: bytes):
        if content[:8] != MAGIC:
            raise ValueError("not a token-id file")
        self.bits, self.block, self.n_docs, self.n_ids, blocks = map(int, np.frombuffer(content, "<u8", 5, 8))
        at = 48
        self.docs = np.frombuffer(content, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.null = np.frombuffer(content, np.uint8, self.n_docs, at)
        at += self.n_docs
        self.ends = np.frombuffer(content, "<u8", self.n_docs, at).astype(np.int64)
        at += 8 * self.n_docs
        self.starts = np.frombuffer(content, "<u8", blocks + 1, at).astype(np.int64)
        self.payload = np.frombuffer(content, np.uint8, -1, at + 8 * (blocks + 1))

    def ids(self, first: int, count: int) -> np.ndarray:
        out = []
        while count:
            k, inside = divmod(first, self.block)
            n = min(count, self.block - inside)
            out.append(unpack(self.payload[self.starts[k] : self.starts[k + 1]], inside, n, self.bits))
            first, count = first + n, count - n
        return np.concatenate(out) if out else np.empty(0, dtype=np.uint32)

    def document(self, k: int) -> np.ndarray:
        begin = int(self.ends[k - 1]) if k else 0
        return self.ids(begin, int(self.ends[k]) - begin)

    def all_ids(self) -> np.ndarray:
        if self.n_ids and self.block * self.bits % 8 == 0:  # whole blocks leave no gap between them
            return unpack(self.payload, 0, self.n_ids, self.bits)
        return self.ids(0, self.n_ids)


#: Fixed values of the word format, for lower-case Latin text: the words that merges never leave.
WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00e0-\u00f6\u00f8-\u024f\u00df]+|[0-9]|[^\\sa-z0-9\u00e0-\u00f6\u00f8-\u024f\u00df]+")
#: Text for which WORD holds: every character is its own normal form and has one lower-case form, and white space is
#: what the tokenizer takes for it too.
LATIN = re.compile("[\t-\r -~\u00a0\u00c0-\u012f\u0131-\u024f]*")


#: Fixed values of the word format, as its file states them: how texts are made normal, and where they are parted.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PARTED = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def fits(spec: dict) -> bool:
    """Whether a tokenizer file is of the word format, for which parts of a text can be encoded one by one."""
    normal, parted, model = (spec.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    steps = parted.get("pretokenizers") or [{}]
    return (
        normal.get("normalizers") == NORMAL
        and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
        and steps[0]["pattern"] == {"Regex": PARTED}
        and (steps[0]["behavior"], steps[0]["invert"], steps[1]["add_prefix_space"], steps[1]["use_regex"]) == ("Removed", True, False, False)
        and (model.get("type"), model.get("dropout"), model.get("end_of_word_suffix")) == ("BPE", None, "</w>")
    )


class ChunkEncoder:
    """The library's ids of whole texts, from those of their parts, which a worker remembers.

    Sound for tokenizers that drop white space before anything else sees it: no word, merge or normal form spans it.
    Latin text is cut into its words, other text at white space only.
    """

    #: Parts that the library gets at once.
    TOGETHER = 5_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known = C.Remembered(64 << 20)

    def _cut(self, text: str) -> list[str]:
        if LATIN.fullmatch(text) and not any(s in text for s in self.special):
            return WORD.findall(text.lower())
        return CHUNK.findall(text) if ODD.search(text) else text.split()

    def _learn(self, parts: list[str]) -> None:
        """Lower-case ASCII letters are their own normal form, one word and their own byte symbols: the library's model
        takes them as they are. Other parts go through all of the library's steps."""
        tokenize, other = self.library.model.tokenize, []
        found = {}
        for w in parts:
            if w.isascii() and w.isalpha() and w.islower():
                found[w] = array("I", [t.id for t in tokenize(w)]).tobytes()
            else:
                other.append(w)
        self.known.learn(found)
        for k in range(0, len(other), self.TOGETHER):
            some = other[k : k + self.TOGETHER]
            self.known.learn(dict(zip(some, (array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(some, add_special_tokens=False)), strict=True)))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        cut = [self._cut(t) for t in texts]
        self._learn(self.known.missing(set().union(*cut)))
        known = self.known.new.__getitem__
        return [b"".join(map(known, c)) for c in cut]


@cache
def encoder(path: str) -> ChunkEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ChunkEncoder(path)


def write_tokens(docs: DataFrame, where: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1) -> None:
    """Writes the table of files `where` (part, seq, base, first_doc, n_docs, n_ids, content), in ascending doc_id order;
    base counts the ids of the part's files before this one.

    Null text counts as empty and gives the end id alone. A null doc_id comes first. Rows that repeat an id keep an
    order by their tokens. An empty table gives no file. A text of more ids than a file has makes a file of its own. Other
    columns of docs, whatever their names, are not read. A tokenizer file of another format than `fits` is refused.
    """
    path = C.vocabulary_path(tokenizer)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not fits(spec):
        raise ValueError(f"{path} does not drop white space and part words as this encoder does")
    size = 1 + max([end_id, *spec["model"]["vocab"].values(), *[t["id"] for t in spec.get("added_tokens") or []]])
    spark = docs.sparkSession
    own, bits = C.texts(docs), bits_for(size)
    parts, unit = C.parts(spark), "<u2" if bits <= 16 else "<u4"
    # Ids alone tell where ranges end; texts are encoded where they lie, and their tokens, not they, go to their range.
    known = own.select("doc_id").where("doc_id is not null")
    ends = np.unique(np.array(known.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 1 / (8 * parts)), dtype=np.int64)) if parts > 1 else np.empty(0, dtype=np.int64)

    def encode(batches):
        for piece in C.pieces(batches):
            got = [np.append(np.frombuffer(x, dtype="<u4"), np.uint32(end_id)).astype(unit).tobytes() for x in encoder(path).encode_batch([x or "" for x in piece.column("text").to_pylist()])]
            part = np.searchsorted(ends, np.array([d if d is not None else NULL_FIRST for d in C.ids(piece)], dtype=np.int64), side="right").astype(np.int32)
            yield C.batch_of(["part", "doc_id", "ids"], [part, piece.column("doc_id"), got], [pa.int32(), pa.int64(), pa.binary()])

    encoded = own.mapInArrow(C.tidied(encode, False), "part int, doc_id long, ids binary")
    ordered = encoded.repartitionById(len(ends) + 1, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")

    def run(batches):
        key, seq, base, held_docs, held_ids, n = None, 0, 0, [], [], 0

        def flush():
            return C.batch_of(["part", "seq", "base", "first_doc", "n_docs", "n_ids", "content"], [[key], [seq], [base], [held_docs[0]], [len(held_docs)], [n], [write_file(held_docs, held_ids, bits)]], [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary()])

        for batch in batches:
            for part, doc, got in zip(batch.column("part").to_pylist(), C.ids(batch), batch.column("ids"), strict=True):
                one = np.frombuffer(got.as_buffer(), dtype=unit)
                if held_docs and (part != key or n + len(one) > FILE_IDS):
                    yield flush()
                    seq, base, held_docs, held_ids, n = (seq + 1, base + n, [], [], 0) if part == key else (0, 0, [], [], 0)
                key = part
                held_docs.append(doc)
                held_ids.append(one)
                n += len(one)
        if held_docs:
            yield flush()

    ordered.mapInArrow(C.tidied(run, False), "part int, seq int, base long, first_doc long, n_docs long, n_ids long, content binary").write.option("compression", "uncompressed").parquet(where)


def read_tokens(spark, where: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit), from the files alone; a table without files gives no row."""
    return _from_files(spark, where, True)


def _from_files(spark, where: str, with_ids: bool) -> DataFrame:
    files = spark.read.parquet(where)
    whole = files.groupBy("part").agg(F.sum("n_ids").alias("all_ids"))
    whole = whole.select("part", F.coalesce(F.sum("all_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("part_base"))
    # A row for each writing task, not for each file or document.
    placed = files.join(F.broadcast(whole), "part").select((F.col("base") + F.col("part_base")).alias("start"), "content")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                f = TokenFile(batch.column("content")[k].as_py())
                flat = memoryview(f.all_ids().astype("<u4")).cast("B")
                begins = np.concatenate([[0], f.ends[:-1]]).astype(np.int64)
                cut = (flat[4 * a : 4 * b] for a, b in zip(begins.tolist(), f.ends.tolist(), strict=True))
                docs = [None if no else d for d, no in zip(f.docs.tolist(), f.null.tolist(), strict=True)]
                yield C.batch_of(["doc_id", "start", "n_tokens", "ids" if with_ids else "ids_crc32"], [docs, begins + batch.column("start")[k].as_py(), f.ends - begins, [bytes(x) if with_ids else zlib.crc32(x) for x in cut]], [pa.int64(), pa.int64(), pa.int64(), pa.binary() if with_ids else pa.int64()])

    return placed.mapInArrow(C.tidied(run), f"doc_id long, start long, n_tokens long, {'ids binary' if with_ids else 'ids_crc32 long'}")


def token_index(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, where: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from files that it writes first.

    Nulls, ties, repeated rows, long texts and empty tables: see write_tokens. Without `where` the files go with the
    session.
    """
    spark = docs.sparkSession
    if not where:
        where = f"{C.shared_dir(spark)}/loomspark/tokens-{uuid.uuid4().hex}"
        C.delete_on_exit(spark, where)
    write_tokens(docs, where, tokenizer, end_id)
    return _from_files(spark, where, False)
