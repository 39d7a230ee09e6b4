"""SimHash near-dedup by deletion-variant signatures.

Two 64-bit fingerprints that differ at `bits` or fewer places have, when cut into (bits + 2) // 2 segments, one segment
that differs by one bit at most. So every fingerprint is filed under each segment as it is and under each segment with
one bit set aside; equal keys meet, and the whole fingerprints decide. Meetings are among distinct fingerprints, and a
meeting hands on only the links that join its members, never all pairs. A key that very many share is not worked on in
one piece: its members are filed again under variants of what is left of the fingerprint.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C
from . import windows as V
from .components import components
from .substrings import Words

#: Members of a key up to which all its links are candidates, where each is verified later; of larger ones a shortest
#: forest is tried first, and what its failing links leave apart is compared in blocks.
DENSE = 16
#: Texts, and bytes of their shingles, of one block when texts that candidates leave apart are compared with each other.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Fingerprints by independent hashes, of which one must be near: each finds most pairs that the others miss.
PRINTS = tuple(f"print{k}" for k in range(3))
#: Members of a key from which they are dealt out anew.
CROWD = 4096


def _majority(h: np.ndarray) -> int:
    """Bit by bit the majority of 64-bit hashes; ties give zeros."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The majority of the shingles' hashes; zero for texts without words."""
    words = text.lower().split()  # of bytes: both touch ASCII only
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[len(words) - n :]
    digest = xxhash.xxh64_intdigest
    return _majority(np.array([digest(whole[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)], dtype="<u8"))


def word_fingerprints(text: bytes) -> list[int]:
    """Fingerprints, by independent hashes, of a text's distinct words."""
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w, 42) for w in set(text.lower().split())], dtype="<u8")
    return [_majority(C.mixed(h + np.uint64(k)) if k else h) for k in range(len(PRINTS))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, print (the fingerprint, as a signed long)."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        return C.batch_of(["doc_id", "print"], [C.ids(piece), [signed(fingerprint(t, shingle)) for t in C.raw(piece)]], [pa.int64()] * 2)

    return C.map_slices(C.texts(docs), run, "doc_id long, print long")


def segments(bits: int) -> list[tuple[int, int]]:
    """(low bit, width) of the fewest segments of which one differs by one bit at most."""
    n = (bits + 2) // 2
    cuts = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _keys(fp: np.ndarray, parts: list[tuple[int, int]], wild: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All (kind, masked value) keys, a column for each variant."""
    kinds, values = [], []
    for a, width in parts:
        mask = np.uint64(((1 << width) - 1) << a)
        for bit in [None, *range(a, a + width)] if wild else [None]:
            own = mask if bit is None else mask & ~np.uint64(1 << bit)
            kinds.append(a << 8 | (0 if bit is None else bit + 1))
            values.append(fp & own)
    return np.array(kinds, dtype=np.int64), np.stack(values, axis=1)


def _closest(fp: np.ndarray, bits: int, side: np.ndarray | None) -> list[tuple[int, int]]:
    """The links of a shortest spanning forest: in each round every group takes its closest link to another one."""
    n = len(fp)
    label, out = np.arange(n), []
    step = max(1, (1 << 20) // n)
    while True:
        best = np.full(n, 1 << 60)  # of each group: distance, then both ends, smaller one first
        for k in range(0, n, step):
            d = np.bitwise_count(fp[k : k + step, None] ^ fp[None, :]).astype(np.int64)
            ok = (d <= bits) & (label[k : k + step, None] != label[None, :])
            if side is not None:
                ok &= side[k : k + step, None] != side[None, :]
            i, j = np.nonzero(ok)
            if len(i):
                low, high = np.minimum(i + k, j), np.maximum(i + k, j)
                np.minimum.at(best, label[i + k], (d[i, j] << 48) | (low << 24) | high)
        took = np.unique(best[best < 1 << 60])
        if not len(took):
            return out
        for e in took.tolist():
            a, b = e >> 24 & 0xFFFFFF, e & 0xFFFFFF
            x, y = label[a], label[b]
            if x != y:
                label[label == max(x, y)] = min(x, y)
                out.append((a, b))


def links(fp: np.ndarray, bits: int, wild: int, dense: int = 0) -> list[tuple[int, int]]:
    """Index pairs that differ at `bits` places or fewer, just enough to join all that such pairs join; all of them
    where there are `dense` members at most.

    wild: the bit set aside plus one, or 0. Only pairs that differ there count: others share the unaltered key.
    """
    n = len(fp)
    side = (fp >> np.uint64(max(wild, 1) - 1)) & np.uint64(1)
    if wild and (side.all() or not side.any()):
        return []
    if n <= dense:
        i, j = np.triu_indices(n, 1)
        ok = (np.bitwise_count(fp[i] ^ fp[j]) <= bits) & ((side[i] != side[j]) if wild else True)
        return list(zip(i[ok].tolist(), j[ok].tolist(), strict=True))
    varying = int(np.bitwise_or.reduce(fp) ^ np.bitwise_and.reduce(fp))
    free = [b for b in range(64) if varying >> b & 1]
    near = 1 + len(free) * (1 + (len(free) - 1) * (1 + (len(free) - 2) / 3) / 2)
    if n <= 4096 or n < 16 * near or bits > 3:
        return _closest(fp, bits, side if wild else None)
    parent, out = np.arange(n), []

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def unite(i, j):
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((a, b))

    order = np.argsort(fp)
    ranked = fp[order]
    for d in range(1, bits + 1):  # few bits vary: try every way to differ
        from itertools import combinations

        for flip in combinations(free, d):
            if wild and wild - 1 not in flip:
                continue
            other = ranked ^ np.uint64(sum(1 << b for b in flip))
            at = np.minimum(np.searchsorted(ranked, other), n - 1)
            hit = np.flatnonzero((ranked[at] == other) & (np.arange(n) < at))
            unite(order[hit], order[at[hit]])
    return out


def _file(parts, rest: bool, bits: int):
    """Mapper: the keys of each fingerprint. rest: rows already have a key (kind, value), and get a second one."""

    def run(batches):
        for batch in batches:
            if not rest:
                for k in range(0, batch.num_rows, 20_000):
                    fp = batch.column("print").slice(k, 20_000).to_numpy(zero_copy_only=False).view(np.uint64)
                    kinds, values = _keys(fp, parts)
                    m = len(kinds)
                    yield C.batch_of(["kind", "value", "print"], [np.tile(kinds, len(fp)), values.reshape(-1).view(np.int64), np.repeat(fp, m).view(np.int64)], [pa.int64()] * 3)
            else:
                fp = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
                kind, value = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "value"))
                for code in np.unique(kind):
                    for k in range(0, len(at := np.flatnonzero(kind == code)), 5_000):
                        own = at[k : k + 5_000]
                        a = int(code) >> 8
                        width = next(w for x, w in parts if x == a)
                        left = [b for b in range(64) if not a <= b < a + width]
                        many = (bits + 2) // 2
                        cuts = [len(left) * x // many for x in range(many + 1)]
                        kinds, values = _variants(fp[own], [left[x:y] for x, y in zip(cuts, cuts[1:])])
                        m = len(kinds)
                        yield C.batch_of(["kind", "value", "kind2", "value2", "print"], [np.repeat(kind[own], m), np.repeat(value[own], m), np.tile(kinds, len(own)), values.reshape(-1).view(np.int64), np.repeat(fp[own], m).view(np.int64)], [pa.int64()] * 5)

    return run


def _variants(fp: np.ndarray, groups: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    kinds, values = [], []
    for g, own in enumerate(groups):
        mask = np.uint64(sum(1 << b for b in own))
        for bit in [None, *own]:
            kinds.append(g << 8 | (0 if bit is None else bit + 1))
            values.append(fp & (mask if bit is None else mask & ~np.uint64(1 << bit)))
    return np.array(kinds, dtype=np.int64), np.stack(values, axis=1)


def _meet(bits: int, last: bool, dense: int):
    """Reducer over rows sorted by key. A key's members are held up to CROWD; of a larger one they are passed on."""
    names = ["kind", "value", "kind2", "value2"] if last else ["kind", "value"]

    def run(batches):
        held_key, held, crowd = None, [], False

        def close():
            if crowd or not held:
                return None
            fp = np.unique(np.concatenate(held))
            if len(fp) < 2:
                return None
            got = links(fp, bits, held_key[0] & 0xFF, dense)
            if not got:
                return None
            i, j = np.array(got).T
            return fp[i].view(np.int64), fp[j].view(np.int64)

        made: list = []

        def emit(a, b, kind=None, value=None):
            n = len(a)
            made.append((a, b, np.full(n, -1) if kind is None else kind, np.zeros(n, dtype=np.int64) if value is None else value))

        def flush():
            got = [np.concatenate(x) for x in zip(*made, strict=True)]
            made.clear()
            return C.batch_of(["a", "b", "kind", "value"], got, [pa.int64()] * 4)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            fp = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            begins, ends = np.concatenate([[0], change]), np.concatenate([change, [n]])
            first = True
            wide = ends - begins
            for k in np.flatnonzero((wide > 1) | (begins == 0) | (ends == n)).tolist():
                a, b = int(begins[k]), int(ends[k])
                key = tuple(int(c[a]) for c in cols)
                if key != held_key:
                    if (got := close()) is not None:
                        emit(*got)
                    held_key, held, crowd = key, [], False
                if crowd:
                    emit(fp[a:b].view(np.int64), np.zeros(b - a, dtype=np.int64), cols[0][a:b], cols[1][a:b])
                    continue
                held.append(fp[a:b])
                if not last and sum(map(len, held)) > CROWD:
                    crowd = True
                    every = np.concatenate(held)
                    emit(every.view(np.int64), np.zeros(len(every), dtype=np.int64), np.full(len(every), key[0]), np.full(len(every), key[1]))
                    held = []
            if sum(len(x[0]) for x in made) > 20_000:
                yield flush()
        if (got := close()) is not None:
            emit(*got)
        if made:
            yield flush()

    return run


EDGE = "a long, b long, kind long, value long"


def near_links(prints: DataFrame, bits: int = 3, dense: int = 0) -> DataFrame:
    """Links (a, b) between distinct fingerprints of the column `print`, enough to join all within `bits` of each other;
    under keys of `dense` members at most, all links."""
    parts = segments(bits)
    n = C.parts(prints.sparkSession)
    filed = prints.select("print").distinct().mapInArrow(C.tidied(_file(parts, False, bits)), "kind long, value long, print long")
    met = C.materialise(filed.repartition(n, "kind", "value").sortWithinPartitions("kind", "value").mapInArrow(C.tidied(_meet(bits, False, dense)), EDGE), "links")
    again = met.where("kind >= 0").select("kind", "value", F.col("a").alias("print")).mapInArrow(C.tidied(_file(parts, True, bits)), "kind long, value long, kind2 long, value2 long, print long")
    keys = ["kind", "value", "kind2", "value2"]
    crowds = again.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(C.tidied(_meet(bits, True, dense)), EDGE)
    return met.where("kind < 0").select("a", "b").unionByName(crowds.select("a", "b")).distinct()


def simhash_components(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id, one row for each row of docs.

    component_id is the smallest doc_id reachable over links, the document itself included. Texts that are null or
    without words have fingerprint zero and are linked like any other. A null doc_id joins components but never names
    one that has another id. Texts are read whole. Repeated rows share a component; an empty table gives an empty result.
    Other columns of docs, whatever their names, are not read.
    """
    prints = C.materialise(fingerprints(docs, shingle), "prints")
    first = prints.groupBy("print").agg(F.min("doc_id").alias("first"))
    joined = components(near_links(prints, bits))  # node, root
    named = joined.join(first, F.col("node") == F.col("print")).groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = first.join(joined, F.col("print") == F.col("node"), "left").join(named, "root", "left").select("print", F.coalesce("component_id", "first").alias("component_id"))
    return prints.join(of_print, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of the distinct shingles in order; fewer words make one shingle, none make none."""
    words = text.lower().split()
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(b" ".join(words[k : k + shingle])) for k in range(max(1, len(words) - shingle + 1))] if words else [], dtype="<u8"))


def _alike(rows: pa.Table, similarity: float) -> list[tuple[int, int]]:
    """Links (node, node) that hold, just enough to join all that such links join.

    Of two blocks, pairs across them only. A set met with many others is counted against all at once, by the texts of each
    shingle.
    """
    node, own, lo, hi = (rows[c].to_numpy() for c in ("node", "own", "lo", "hi"))
    sets = [np.frombuffer(x, "<u8") for x in rows["shingles"].to_pylist()]
    n, size = len(sets), np.array([len(x) for x in sets])
    root = np.arange(n)
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    posts = np.repeat(np.arange(n), size)[np.argsort(token, kind="stable")]
    begin, at = np.cumsum(times) - times, np.concatenate([[0], np.cumsum(size)])
    out = []
    for i in range(n - 1):
        ok = root[i + 1 :] != root[i]
        ok &= np.minimum(size[i + 1 :], size[i]) >= similarity * np.maximum(size[i + 1 :], size[i]) - 1e-9
        if lo[0] != hi[0]:
            ok &= own[i + 1 :] != own[i]
        if not len(j := np.flatnonzero(ok) + i + 1):
            continue
        if len(j) <= 16:
            both = np.array([len(np.intersect1d(sets[i], sets[k], assume_unique=True)) for k in j])
        else:
            mine = token[at[i] : at[i + 1]]
            wide = times[mine]
            places = np.arange(wide.sum()) + np.repeat(begin[mine] - np.cumsum(wide) + wide, wide)
            both = np.bincount(posts[places], minlength=n)[j]
        for k in j[both >= similarity * (size[i] + size[j] - both) - 1e-9].tolist():
            if root[k] != root[i]:
                root[root == root[k]] = root[i]
                out.append((int(node[i]), int(node[k])))
    return out


def _blocks(similarity: float):
    """Reducer over rows sorted by group, lo, hi: the links of each such key."""

    def run(batches):
        held_key, held = None, []

        def close():
            got = _alike(pa.Table.from_batches(held), similarity) if sum(map(len, held)) > 1 else []
            return C.batch_of(["a", "b"], [[a for a, _ in got], [b for _, b in got]], [pa.int64()] * 2)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in ("group", "lo", "hi")]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
                key = tuple(int(c[a]) for c in cols)
                if key != held_key:
                    if held:
                        yield close()
                    held_key, held = key, []
                held.append(batch.slice(a, b - a))
        if held:
            yield close()

    return run


def _left_apart(checked: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that hold where a candidate's failure could hide them. checked: candidates (a, b, holds).

    All pairs that are alike lie inside a group that candidates join. A group is done when all its
    candidates hold, or when all its pairs were candidates. Of others every text meets every block of its group, with
    its shingles.
    """
    groups = C.materialise(components(checked.select("a", "b")).select("node", F.col("root").alias("group")), "groups")
    of_node = checked.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("tried"), F.count_if(~F.col("holds")).alias("lost"))  # so that a text with very many candidates is one row
    tried = of_node.join(groups, "node").groupBy("group").agg(F.sum("tried").alias("tried"), F.sum("lost").alias("lost")).where("lost > 0")
    still = groups.groupBy("group").agg(F.count("*").alias("n")).join(tried, "group").where("tried < n * (n - 1) div 2").select("group", "n")
    rows = C.materialise(groups.join(still, "group").join(known, "node"), "apart")
    many = rows.groupBy("group").agg(F.ceil(F.greatest(F.first("n") / BLOCK, F.sum(F.length("shingles")) / BLOCK_BYTES, F.lit(1))).alias("many"))
    dealt = rows.join(many, "group").withColumn("own", F.pmod(F.xxhash64("node"), "many")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)))
    keys = ["group", "lo", "hi"]
    met = dealt.select("group", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "shingles")
    return met.repartition(C.parts(known.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(C.tidied(_blocks(similarity)), "a long, b long")


def _candidates(nodes: DataFrame, column: str, bits: int) -> DataFrame:
    """x, y: the links of near_links between one text each of the fingerprints, and of each fingerprint's texts to it."""
    heads = nodes.groupBy(F.col(column).alias("print")).agg(F.min("node").alias("head"))
    between = near_links(heads.select("print"), bits, DENSE).join(heads.select(F.col("print").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("print").alias("b"), F.col("head").alias("y")), "b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    inside = nodes.join(heads, nodes[column] == heads["print"]).where("node <> head").select(F.col("head").alias("x"), F.col("node").alias("y"))
    return between.unionByName(inside)


def _shingle_keys(piece: pa.RecordBatch, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Document (place in the piece) and hash of its distinct shingles, by document; fewer words make one shingle."""
    words = Words([t.lower() for t in C.raw(piece)])
    n = len(words.doc)
    first = np.cumsum(words.counts) - words.counts
    at = np.flatnonzero(words.doc[: max(0, n - shingle + 1)] == words.doc[shingle - 1 :])
    docs, keys = [words.doc[at]], [words.chained(0, at, shingle)]
    for few in range(1, shingle):
        own = np.flatnonzero(words.counts == few)
        docs.append(own)
        keys.append(words.chained(0, first[own], few))
    doc, key = np.concatenate(docs), np.concatenate(keys)
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    fresh = np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])) if len(doc) else np.empty(0, dtype=bool)
    return doc[fresh], key[fresh]


PACKED = "bucket int, piece long, docs binary, keys binary, times binary, hashes binary, needs binary"
PACKED_NAMES = ["bucket", "piece", "docs", "keys", "times", "hashes", "needs"]
PACKED_TYPES = [pa.int32(), pa.int64()] + [pa.binary()] * 5
#: Shingles of a task that are handed on together, and bytes of input that a bucket of shingles stands for.
GATHERED, BUCKET_BYTES = 400_000, 4 << 20


def _filed_shingles(shingle: int, similarity: float, buckets: int):
    """Mapper from texts to rows of PACKED: of each bucket the documents (by place in the piece) and shingles, 40 bits each,
    and of each piece the texts' hashes and, in `needs`, how many first shingles count and how many even ones there are.

    All even shingles go, and of the odd ones those that are still among a text's first where it has few even ones."""

    def run(batches):
        held, size, number = [], 0, C.counter()

        def flush():
            piece = next(number)
            first = np.cumsum([0, *(len(h[0]) for h in held)])
            doc = np.concatenate([h[2] + k for h, k in zip(held, first)])
            key = np.concatenate([h[3] for h in held])
            bucket = (key & np.uint64(0xFFFFFF)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            doc, key, bucket = doc[order].astype("<u4"), key[order] >> np.uint64(24), bucket[order]
            five = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            needs = np.concatenate([h[1] for h in held]).astype("<u4")
            out = [(piece % buckets, piece, None, None, None, b"".join(x for h in held for x in h[0]), V.squeeze(needs))]
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True) if len(bucket) else ():
                out.append((int(bucket[x]), piece, V.squeeze(doc[x:y]), five[x:y].tobytes(), None, None, None))
            held.clear()
            return C.batch_of(PACKED_NAMES, [list(c) for c in zip(*out, strict=True)], PACKED_TYPES)

        for batch in batches:
            for piece in C.slices(batch, V.PIECE):
                doc, key = _shingle_keys(piece, shingle)
                raw = C.raw(piece)
                n = np.bincount(doc, minlength=len(raw))
                need = np.where(n > 0, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)
                odd = (key >> np.uint64(24)) & np.uint64(1) == 1
                even = np.bincount(doc[~odd], minlength=len(raw))
                at = np.flatnonzero(odd)
                count = np.bincount(doc[at], minlength=len(raw))
                place = np.arange(len(at)) - (np.cumsum(count) - count)[doc[at]]
                goes = ~odd
                goes[at] = place < (need - even)[doc[at]]
                held.append(([hashlib.sha256(t).digest() for t in raw], np.stack([need, even], axis=1), doc[goes], key[goes]))
                size += int(goes.sum())
                if size >= GATHERED:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _shared_shingles(batches):
    """Reducer over rows of PACKED sorted by bucket: of each piece the shingles that several texts have, and in how many."""
    held, bucket = [], None

    def close():
        docs = [V.loosen(d, "<u4") for _, d, _ in held]
        size = np.array([len(d) for d in docs])
        wide = np.zeros((int(size.sum()), 8), dtype=np.uint8)
        wide[:, :5] = np.frombuffer(b"".join(k for _, _, k in held), dtype=np.uint8).reshape(-1, 5)
        key = wide.view("<u8").reshape(-1)
        order = np.argsort(key)
        ranked = key[order]
        start = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        wide_of = np.diff(np.append(start, len(ranked)))
        times = np.empty(len(key), dtype="<u4")
        times[order] = np.repeat(wide_of, wide_of)
        out, end = [], 0
        for (piece, _, keys), doc, n in zip(held, docs, size.tolist(), strict=True):
            own = times[end : end + n]
            end += n
            if (some := own > 1).any():
                five = np.frombuffer(keys, dtype=np.uint8).reshape(-1, 5)[some]
                out.append((bucket, piece, V.squeeze(doc[some]), five.tobytes(), V.squeeze(own[some]), None, None))
        held.clear()
        return out

    def batch_of(rows):
        return C.batch_of(PACKED_NAMES, [list(c) for c in zip(*rows, strict=True)], PACKED_TYPES)

    for batch in batches:
        passed = []
        for row in zip(*(batch.column(c).to_pylist() for c in PACKED_NAMES), strict=True):
            if row[0] != bucket and held:
                passed += close()
            bucket = row[0]
            if row[5] is None:
                held.append(row[1:4])
            else:
                passed.append(row)
        if passed:
            yield batch_of(passed)
    if held and (rows := close()):
        yield batch_of(rows)


def _first_shingles(batches):
    """Reducer over rows of PACKED sorted by piece: hash, keys: the shared ones among the first shingles of each text that
    has any."""
    held, piece = [], None

    def close():
        meta = next((h for h in held if h[5] is not None), None)
        rest = [h for h in held if h[5] is None]
        if meta is None or not rest:
            return None
        need, even = V.loosen(meta[6], "<u4").astype(np.int64).reshape(-1, 2).T
        doc = np.concatenate([V.loosen(h[2], "<u4") for h in rest]).astype(np.int64)
        times = np.concatenate([V.loosen(h[4], "<u4") for h in rest]).astype(np.int64)
        wide = np.zeros((len(doc), 8), dtype=np.uint8)
        wide[:, :5] = np.frombuffer(b"".join(h[3] for h in rest), dtype=np.uint8).reshape(-1, 5)
        key = wide.view("<i8").reshape(-1)
        odd = key & 1
        key = key << 23 | np.repeat([h[0] for h in rest], [len(h[3]) // 5 for h in rest])
        order = np.lexsort((key, times, odd, doc))
        doc, key, odd = doc[order], key[order], odd[order]
        count = np.bincount(doc, minlength=len(need))
        alone = even - np.bincount(doc[odd == 0], minlength=len(need))  # these come first
        first = np.cumsum(count) - count
        goes = (odd == 1) | (np.arange(len(doc)) - first[doc] < (need - alone)[doc])
        doc, key = doc[goes], key[goes]
        cuts = [0, *(np.flatnonzero(doc[1:] != doc[:-1]) + 1).tolist(), len(doc)]
        out = {}  # texts that the piece has twice count once
        for x, y in zip(cuts[:-1], cuts[1:], strict=True) if len(doc) else ():
            out[meta[5][32 * doc[x] : 32 * doc[x] + 32]] = key[x:y]
        return C.batch_of(["hash", "keys"], [list(out), list(out.values())], [pa.binary(), pa.list_(pa.int64())]) if out else None

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in PACKED_NAMES), strict=True):
            if row[1] != piece and held:
                if (got := close()) is not None:
                    yield got
                held = []
            piece = row[1]
            held.append(row)
    if held and (got := close()) is not None:
        yield got


def _rare_candidates(docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """x, y: links that join all texts whose sets of shingles are alike to `similarity`, and more.

    In any order of all shingles, two such sets of n and m share one of the first n - ceil(similarity * n) + 1 and m - ...:
    here even shingles (by their hash) come first, the rarest of them before others, then odd ones. So only even shingles
    are counted, and the odd ones that are among the first of a text with few even ones. Each goes once, packed, to its
    bucket, where all that are equal meet; what several texts have goes back to the piece it came from, and there most texts
    are done: as many of their shingles as that occur nowhere else. Both grow with the input alone, whatever its size, and
    nothing is held but a bucket or a piece. A shingle of up to DENSE texts links all of them, of a larger one all are linked
    to its first.
    """
    n = C.parts(docs.sparkSession)
    buckets = min(1 << 23, max(4 * n, V.expected_bytes(docs) // BUCKET_BYTES))
    filed = C.texts(docs).select("text").mapInArrow(C.tidied(_filed_shingles(shingle, similarity, buckets)), PACKED)
    shared = filed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(C.tidied(_shared_shingles), PACKED)
    first = shared.repartition(n, "piece").sortWithinPartitions("piece").mapInArrow(C.tidied(_first_shingles), "hash binary, keys array<long>")
    posts = first.dropDuplicates(["hash"]).join(nodes.select("hash", "node"), "hash").select("node", F.explode("keys").alias("key"))
    posts = C.materialise(posts, "posts")
    heads = posts.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("head")).where("n > 1")
    met = posts.join(heads, "key")
    few = met.where(F.col("n") <= DENSE).select("key", "node")
    pairs = few.select("key", F.col("node").alias("x")).join(few.select("key", F.col("node").alias("y")), "key").where("x < y").select("x", "y")
    stars = met.where((F.col("n") > DENSE) & (F.col("head") < F.col("node"))).select(F.col("head").alias("x"), F.col("node").alias("y"))
    return pairs.unionByName(stars).distinct()


def _similar(docs: DataFrame, shingle: int, similarity: float, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, hash), distinct texts (hash, node, first: the smallest doc_id), and the components (node, root) of
    their links. A text is known by its SHA-256, a node by a number."""

    def prints_of(piece: pa.RecordBatch) -> pa.RecordBatch:
        raw = C.raw(piece)
        prints = zip(*[map(signed, word_fingerprints(t)) for t in raw])
        return C.batch_of(["doc_id", "hash", *PRINTS], [C.ids(piece), [hashlib.sha256(t).digest() for t in raw], *map(list, prints)], [pa.int64(), pa.binary(), *[pa.int64()] * len(PRINTS)])

    prints = C.materialise(C.map_slices(C.texts(docs), prints_of, "doc_id long, hash binary, " + ", ".join(f"{c} long" for c in PRINTS)), "prints")
    nodes = prints.groupBy("hash").agg(*[F.first(c).alias(c) for c in PRINTS], F.min("doc_id").alias("first"))
    nodes = C.materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    pairs = functools.reduce(DataFrame.unionByName, [*[_candidates(nodes, c, bits) for c in PRINTS], _rare_candidates(docs, nodes, shingle, similarity)])
    pairs = C.materialise(pairs.distinct(), "candidates")
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()

    def sets(piece: pa.RecordBatch) -> pa.RecordBatch:
        got = [(n, shingle_set(t, shingle).tobytes()) for n, h, t in zip(piece.column("node").to_pylist(), piece.column("hash").to_pylist(), C.raw(piece), strict=True) if h == hashlib.sha256(t).digest()]
        return C.batch_of(["node", "shingles"], [[n for n, _ in got], [x for _, x in got]], [pa.int64(), pa.binary()])

    # A node's text is that of its smallest doc_id; where rows repeat that id, their own hashes tell them apart.
    named_by = nodes.join(wanted, "node", "left_semi").select(F.coalesce("first", F.lit(-1)).alias("id"), "node", "hash")
    own = C.texts(docs).withColumn("id", F.coalesce("doc_id", F.lit(-1))).join(named_by, "id").select("node", "hash", "text")
    known = C.materialise(C.map_slices(own, sets, "node long, shingles binary").dropDuplicates(["node"]), "shingles")

    def verify(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("s"), batch.column("t"), strict=True):
                a, b = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
            yield C.batch_of(["a", "b", "holds"], [batch.column("a"), batch.column("b"), keep], [pa.int64(), pa.int64(), pa.bool_()])

    met = pairs.join(known.select(F.col("node").alias("x"), F.col("shingles").alias("s")), "x").join(known.select(F.col("node").alias("y"), F.col("shingles").alias("t")), "y")
    checked = C.materialise(met.select(F.col("x").alias("a"), F.col("y").alias("b"), "s", "t").mapInArrow(C.tidied(verify), "a long, b long, holds boolean"), "checked")
    joined = components(checked.where("holds").select("a", "b").unionByName(_left_apart(checked, known, similarity)))
    C.discard(pairs, known, checked)
    return prints.select("doc_id", "hash"), nodes.select("hash", "node", "first"), joined


def similar_components(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bits: int = 5) -> DataFrame:
    """doc_id, component_id, one row for each row of docs: texts are linked whose sets of shingles have a Jaccard
    similarity of `similarity` or more.

    Candidates are pairs of which one of the PRINTS fingerprints of the distinct words, by independent hashes, differs at
    `bits` places or fewer, equal ones included, and, so that none is lost, those that share one of their rarest shingles.
    Links that join each group of them are verified first, on the whole shingle sets; where one fails, all texts of the
    group are compared in full. Equal texts are one, and so are all without
    words, nulls among them. component_id is the smallest doc_id, null where all are; repeated rows share it; an empty
    table gives an empty result. Other columns of docs, whatever their names, are not read.
    """
    prints, nodes, joined = _similar(docs, shingle, similarity, bits)
    named = joined.join(nodes, "node").groupBy("root").agg(F.min("first").alias("component_id"))
    of_text = nodes.join(joined, "node", "left").join(named, "root", "left").select("hash", F.coalesce("component_id", "first").alias("component_id"))
    return prints.join(of_text, "hash").select("doc_id", "component_id")


def keep_one_of_near(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bits: int = 5) -> DataFrame:
    """The rows of docs, with their columns under any names, of which each component of similar_components keeps one.

    That with the smallest doc_id stays, a null one only where there is no other; of different texts under that id the
    one with the smallest SHA-256; of rows that repeat id and text one. Null texts count as empty.
    """
    _, nodes, joined = _similar(docs, shingle, similarity, bits)
    best = joined.join(nodes, "node").groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "hash", "node")).alias("best")).select("best.node")
    gone = joined.select("node").join(best, "node", "left_anti")
    row, kept, n = C.spare_names(docs, "row", "kept", "n")
    name = lambda doc, sha: F.concat_ws(":", F.coalesce(doc.cast("string"), F.lit("-")), sha)
    stay = nodes.join(gone, "node", "left_anti").select(name(F.col("first"), F.lower(F.hex("hash"))).alias(kept))
    own = docs.withColumn(row, name(docs["doc_id"].cast("long"), F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary"), 256)))
    once = F.row_number().over(W.partitionBy(row).orderBy(row))
    return own.join(stay, F.col(row) == F.col(kept), "left_semi").withColumn(n, once).where(F.col(n) == 1).drop(n, row)
