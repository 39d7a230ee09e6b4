"""Suffix-array dedup on bytes.

A window of `width` bytes is known by its anchor, the smallest hash among its 16-byte parts. Stretches of windows with
a common anchor are cut out of the texts, and those whose anchor may be in two documents go to the shard of the anchor:
equal windows always meet in one shard. (Stretches of an anchor that is very common go window by window, each to the
shard of its own hash.) A shard's different stretches are joined, with separators, and their suffixes
sorted by induced sorting; permuted common prefixes then tell which windows are equal, whatever stretch they are in.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C
from . import windows as V

#: Bytes of the parts that anchors are chosen from.
PART = 16
#: Stretches of a task that are handed on together.
GATHERED = 150_000
#: Bytes of text that one suffix array covers, unless one anchor's stretches alone are more.
SHARD_BYTES = 512 << 10
#: Alphabets up to this size are induced bucket by bucket, larger ones (they arise in the recursion) suffix by suffix.
ALPHABET = 1024


# --- suffix arrays ---------------------------------------------------------------------------------------------------


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one. s ends in a unique smallest symbol."""
    change = np.flatnonzero(s[1:] != s[:-1])
    rises = s[change + 1] > s[change]
    out = np.empty(len(s), dtype=bool)
    out[:-1] = np.repeat(rises, np.diff(np.append(-1, change)))
    out[-1] = True
    return out


def _place(sa: np.ndarray, at: np.ndarray, s: np.ndarray, suffixes: np.ndarray, step: int) -> None:
    """Appends suffixes, in order, to the buckets of their first symbols; at holds the next free place of each."""
    first = s[suffixes]
    order = np.argsort(first, kind="stable")
    suffixes, first = suffixes[order], first[order]
    start = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
    counts = np.diff(np.append(start, len(first)))
    sa[at[first] + step * (np.arange(len(first)) - np.repeat(start, counts))] = suffixes
    at[first[start]] += step * counts


def _induce(s: np.ndarray, small: np.ndarray, leftmost: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the leftmost-smaller ones in order: larger-type ones bucket by bucket upwards, then
    smaller-type ones downwards. A bucket's members that bring in members of the same bucket take another round."""
    n = len(s)
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = np.full(n, -1, dtype=np.int32)
    present = np.flatnonzero(counts)
    lows = np.zeros(len(counts), dtype=np.int64)
    low_counts = np.bincount(s[leftmost], minlength=len(counts))
    at = ends - low_counts
    _place(sa, at, s, leftmost, 1)
    head = starts.copy()
    for c in present.tolist():
        done = starts[c]
        while done < head[c]:
            batch, done = sa[done : head[c]], head[c]
            before = batch[batch > 0] - 1
            before = before[~small[before]]
            if len(before):
                _place(sa, head, s, before, 1)
        lows[c] = head[c]
        if low_counts[c]:
            batch = sa[ends[c] - low_counts[c] : ends[c]]
            before = batch[batch > 0] - 1
            before = before[~small[before]]
            if len(before):
                _place(sa, head, s, before, 1)
    tail = ends - 1
    for c in present[::-1].tolist():
        done = ends[c] - 1
        while done > tail[c]:
            batch, done = sa[tail[c] + 1 : done + 1][::-1], tail[c]
            before = batch[batch > 0] - 1
            before = before[small[before]]
            if len(before):
                _place(sa, tail, s, before, -1)
        batch = sa[starts[c] : lows[c]][::-1]
        before = batch[batch > 0] - 1
        before = before[small[before]]
        if len(before):
            _place(sa, tail, s, before, -1)
    sa[0] = n - 1
    return sa


def _induce_each(s: np.ndarray, small: np.ndarray, leftmost: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What _induce gives, for alphabets whose buckets hold few suffixes: one after the other, in plain lists.

    An empty place holds suffix 0, which brings in none: the last suffix, at -1, is no larger-type one, and smaller-type
    places are filled before the way back reads them.
    """
    n, s = len(s), s.astype(np.int64)
    ends = np.cumsum(counts)
    sa = np.zeros(n, dtype=np.int64)
    _place(sa, ends - np.bincount(s[leftmost], minlength=len(counts)), s, leftmost, 1)
    sa = sa.tolist()
    head, tail = (ends - counts).tolist(), ends.tolist()
    brought = np.where(small, -1, s).tolist()  # by the suffix behind: the bucket of a larger-type one
    for p in sa:  # reads what it puts in further on
        p -= 1
        c = brought[p]
        if c >= 0:
            k = head[c]
            sa[k] = p
            head[c] = k + 1
    brought = np.where(small, s, -1)
    brought[-1] = -1  # the end is brought in by none
    brought = brought.tolist()
    for p in reversed(sa):
        p -= 1
        c = brought[p]
        if c >= 0:
            k = tail[c] - 1
            sa[k] = p
            tail[c] = k
    sa[0] = n - 1
    return np.array(sa, dtype=np.int32)


def _names(s: np.ndarray, leftmost: np.ndarray, symbols: int) -> np.ndarray:
    """The rank of each leftmost-smaller substring, equal ones alike: as many symbols as fit 63 bits are compared at
    once, further ones among those that are equal so far. What begins like a longer one is larger than that."""
    size = np.append(np.diff(leftmost) + 1, 1)
    width = int(symbols).bit_length()
    per, none = 63 // width, (1 << width) - 1

    def key(k: np.ndarray, far: int) -> np.ndarray:
        out = np.zeros(len(k), dtype=np.int64)
        for x in range(far, far + per):
            inside = size[k] > x
            out = out << width | np.where(inside, s[np.where(inside, leftmost[k] + x, 0)], none)
        return out

    rank = np.zeros(len(leftmost), dtype=np.int64)
    live, far = np.arange(len(leftmost)), 0
    while len(live):
        own, order = key(live, far), None
        order = np.lexsort((own, rank[live])) if far else np.argsort(own)
        live, own = live[order], own[order]
        group = rank[live]
        new = np.append(True, group[1:] != group[:-1])
        fresh = new | np.append(True, own[1:] != own[:-1])
        place = np.arange(len(live)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        first = np.flatnonzero(fresh)
        rank[live] = group + place[first][np.cumsum(fresh) - 1]
        many = np.repeat(np.diff(np.append(first, len(live))), np.diff(np.append(first, len(live)))) > 1
        far += per
        live = live[many & (size[live] >= far)]  # one that ends here meets the longer ones once more, to stand behind them
        live = live[np.argsort(live)]
    return np.unique(rank, return_inverse=True)[1]


def _sorted_suffixes(s: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array of s, which ends in a unique smallest symbol, by induced sorting."""
    n = len(s)
    if n < 3:
        return np.argsort(s, kind="stable")
    small = _types(s)
    leftmost = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    reduced = _names(s, leftmost, symbols)
    many = int(reduced.max()) + 1
    order = np.argsort(reduced) if many == len(reduced) else _sorted_suffixes(reduced, many)
    induce = _induce if symbols <= ALPHABET else _induce_each
    return induce(s, small, leftmost[order], np.bincount(s, minlength=symbols))


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Start places of all suffixes of t (small unsigned integers) in order."""
    s = np.zeros(len(t) + 1, dtype=np.uint16)
    s[:-1] = t
    s[:-1] += 1
    return _sorted_suffixes(s, int(s.max()) + 1)[1:]


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each suffix, by place in the text, the length of the prefix it shares with the one before it in order.

    Only where the symbol to the left differs from that of the neighbour is the length counted out; elsewhere it is
    one less than at the place before.
    """
    n = len(t)
    if not n:
        return np.empty(0, dtype=np.int64)
    prior = np.empty(n, dtype=np.int64)
    prior[sa[0]] = -1
    prior[sa[1:]] = sa[:-1]
    counted = np.ones(n, dtype=bool)
    counted[1:] = (prior[1:] < 1) | (t[:-1] != t[np.maximum(prior[1:], 1) - 1])
    at = np.flatnonzero(counted & (prior >= 0))
    length = np.zeros(n, dtype=np.int64)
    padded = np.concatenate([t.astype(np.uint16) + 1, np.zeros(4, dtype=np.uint16)])

    def four(x):
        return padded[x].astype(np.uint64) | padded[x + 1].astype(np.uint64) << np.uint64(16) | padded[x + 2].astype(np.uint64) << np.uint64(32) | padded[x + 3].astype(np.uint64) << np.uint64(48)

    live, far = at, 0
    while len(live):
        a, b = live + far, prior[live] + far
        inside = np.maximum(a, b) < n
        live, a, b = live[inside], a[inside], b[inside]
        x = four(a) ^ four(b)
        same = x == 0
        low = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 16
        length[live] = far + np.where(same, 4, low)
        live, far = live[same], far + 4
    np.minimum(length, n - np.maximum(np.arange(n), prior), out=length)
    last = np.maximum.accumulate(np.where(counted, np.arange(n), 0))
    return np.maximum(length[last] - (np.arange(n) - last), 0)


def smallest_documents(chunks: list[bytes], first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every window of the chunks the smallest `first` among the chunks it occurs in, and the chunks' offsets.

    Places where no window fits hold the largest integer.
    """
    none = np.iinfo(np.int64).max
    t, off = C.joined([c + b"\0" for c in chunks])
    t = t.astype(np.uint16) + 1
    t[off[1:] - 1] = 0
    sa = suffix_array(t)
    lcp = common_prefixes(t, sa)[sa]
    size = np.diff(off)
    chunk = np.repeat(np.arange(len(chunks)), size)
    fits = np.arange(len(t)) + width < off[chunk + 1]
    value = np.where(fits, first[chunk], none)[sa]
    start = np.flatnonzero(np.append(True, lcp[1:] < width))
    low = np.minimum.reduceat(value, start)
    out = np.empty(len(t), dtype=np.int64)
    out[sa] = np.repeat(low, np.diff(np.append(start, len(sa))))
    out[~fits] = none
    return out, off


# --- shards ----------------------------------------------------------------------------------------------------------


class Stretches:
    """The stretches of windows with a common anchor, of a piece's documents."""

    def __init__(self, chunks: list[bytes], width: int):
        self.t, self.off = C.joined(chunks)
        n = len(self.t)
        self.rolling = V.Rolling(self.t)
        if n < width:
            self.start = self.end = self.doc = np.empty(0, dtype=np.int64)
            self.anchor = np.empty(0, dtype=np.uint64)
            return
        part = min(PART, width)
        anchor = V.lowest(self.rolling.all(part), width - part + 1)
        doc = np.repeat(np.arange(len(chunks)), np.diff(self.off))
        m = n - width + 1
        fits = doc[:m] == doc[width - 1 :]
        fresh = np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:m] != doc[: m - 1]))
        begin = np.flatnonzero(fresh & fits)
        stop = np.flatnonzero(np.append(fresh[1:] | ~fits[1:], True) & fits) + 1
        self.start, self.end, self.doc = begin, stop + width - 1, doc[begin]
        self.anchor = C.mixed(anchor[begin])


#: What a task sends to a shard: its different stretches (anchor, length, text), and all their occurrences (stretch, document
#: and place), whose numbers are one value, so that a shard's share may be small.
ENTRIES = "bucket int, anchor binary, text binary, numbers binary"
ENTRY_NAMES = ["bucket", "anchor", "text", "numbers"]


def _packed_numbers(length, stretch, row, pos, docs, keys) -> bytes:
    """length of each stretch; of each occurrence stretch, row of its document and place; document and key of each row."""
    return V.squeeze(np.concatenate([[len(docs)], length, stretch, row, pos, docs.astype("<i8").view("<u4"), keys.astype("<i4").view("<u4")]).astype("<u4"))


def _unpacked_numbers(x: bytes, stretches: int) -> tuple[np.ndarray, ...]:
    """length, stretch, pos, and document and key of each occurrence."""
    x = V.loosen(x, "<u4")
    d = int(x[0])
    many = (len(x) - 1 - stretches - 3 * d) // 3
    length, stretch, row, pos, docs, keys = np.split(x[1:], np.cumsum([stretches, many, many, many, 2 * d]))
    return length.astype(np.int64), stretch.astype(np.int64), pos.astype(np.int64), docs.view("<i8")[row], keys.view("<i4").astype(np.int64)[row]


def _runs_within(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _distinct(order: np.ndarray, keys: list[np.ndarray], texts: list[bytes]) -> np.ndarray:
    """True where, in the given order, a stretch differs from the one before it: equal keys are a hint, the bytes decide."""
    fresh = np.append(True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)) if len(order) else np.empty(0, dtype=bool)
    for k in np.flatnonzero(~fresh).tolist():
        fresh[k] = texts[order[k]] != texts[order[k - 1]]
    return fresh


def _settled(held: list, width: int) -> list[np.ndarray]:
    """Document, key, first window and length of the removed runs, for all occurrences of a bucket's stretches."""
    anchor, print_, length, texts = [], [], [], []
    stretch, doc, key, pos = [], [], [], []
    at, near, size = 0, [], 0

    def hashed():
        """Prints of the stretches that came last, some shares of a shard at once."""
        text, wide = np.concatenate([t for t, _ in near]), np.concatenate([n for _, n in near])
        ends = np.cumsum(wide)
        print_.append(V.Rolling(text).of(ends - wide, ends))
        whole = text.tobytes()
        texts.extend([whole[x:y] for x, y in zip((ends - wide).tolist(), ends.tolist(), strict=True)])
        near.clear()

    for a, text, numbers in held:
        anchor.append(np.frombuffer(a, "<u8"))
        n, s, where, docs, keys = _unpacked_numbers(numbers, len(anchor[-1]))
        near.append((V.loosen(text, np.uint8), n))
        length.append(n)
        stretch.append(s + at)
        doc.append(docs)
        key.append(keys)
        pos.append(where)
        at += len(n)
        size += len(near[-1][0])
        if size >= V.PIECE:
            hashed()
            size = 0
    if near:
        hashed()
    anchor, print_, length, stretch, doc, key, pos = map(np.concatenate, (anchor, print_, length, stretch, doc, key, pos))
    # Equal stretches of different tasks become one.
    order = np.lexsort((length, print_, anchor))
    fresh = _distinct(order, [anchor, print_, length], texts)
    of = np.empty(len(order), dtype=np.int64)
    of[order] = np.cumsum(fresh) - 1
    kept = order[fresh]
    anchor, stretch = anchor[kept], of[stretch]
    first = np.full(len(kept), np.iinfo(np.int64).max)
    np.minimum.at(first, stretch, doc)
    # Whole stretches that a smaller document has.
    later = doc > first[stretch]
    windows = length[kept] - width + 1
    spans = [(doc[later], key[later], pos[later], windows[stretch[later]])]
    # In the smallest document of a stretch, windows that other stretches of the anchor have in a smaller one still.
    start = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    many = np.repeat(np.diff(np.append(start, len(anchor))) > 1, np.diff(np.append(start, len(anchor))))
    k = np.flatnonzero(many)  # alone under its anchor, a stretch shares no window
    if len(k):
        group = np.cumsum(np.append(True, anchor[1:] != anchor[:-1]))[k]
        sizes = np.cumsum(length[kept[k]])
        cuts, begin = [], 0
        for b in np.flatnonzero(np.append(np.diff(group) != 0, True)) + 1:
            if b == len(k) or sizes[b - 1] - (sizes[begin - 1] if begin else 0) >= SHARD_BYTES:
                cuts.append((begin, int(b)))
                begin = int(b)
        by_stretch = np.argsort(stretch, kind="stable")
        bounds = np.searchsorted(stretch[by_stretch], np.arange(len(kept) + 1))
        for b, e in cuts:
            own = k[b:e]
            low, off = smallest_documents([texts[kept[i]] for i in own], first[own], width)
            chunk = np.repeat(np.arange(len(own)), np.diff(off))
            beats = low < first[own][chunk]
            x, y = _runs_within(beats)
            for u, v in zip(x.tolist(), y.tolist(), strict=True):
                c = int(chunk[u])
                rows = by_stretch[bounds[own[c]] : bounds[own[c] + 1]]
                rows = rows[~later[rows]]
                spans.append((doc[rows], key[rows], pos[rows] + (u - off[c]), np.full(len(rows), v - u)))
    return [np.concatenate(c) for c in zip(*spans, strict=True)]


def byte_dedup(docs: DataFrame, width: int = 50, sketch_bits: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text (binary), one row for each row of docs.

    Removed is each byte covered by a string of `width` bytes that also starts in a document with a smaller doc_id;
    n_spans counts the maximal removed runs. Null text counts as empty; rows with a null doc_id keep all and remove
    nothing; rows that repeat a doc_id do not remove from each other; an empty table gives an empty result. Long texts
    are cut into stretches like any other. Other columns of docs, whatever their names, are not read. sketch_bits sets
    the size of the filter on anchors (2 ** (sketch_bits + 1) bits broadcast; by default it follows the input, see
    windows.fitting_bits) and the speed, never the result.
    """
    spark = docs.sparkSession
    rows = V.keyed(docs)
    read = rows.where("doc_id is not null and text is not null")
    sketch_bits = sketch_bits or V.fitting_bits(docs)

    def anchors(piece):
        s = Stretches(C.raw(piece), width)
        return V.once_a_document(s.anchor, s.doc)

    cells, often = V.repeated_cells(read.select("text"), anchors, sketch_bits)
    twice, common = spark.sparkContext.broadcast(cells), spark.sparkContext.broadcast(often)
    n = C.parts(spark)
    shards = 4 * n

    def gather(batches):
        held, size = [], 0

        def flush():
            anchor, print_, length, doc, key, pos = (np.concatenate([h[k] for h in held]) for k in range(6))
            texts = [x for h in held for x in h[6]]
            held.clear()
            order = np.lexsort((length, print_, anchor))
            fresh = _distinct(order, [anchor, print_, length], texts)
            of = np.cumsum(fresh) - 1
            kept = order[fresh]
            bucket = (anchor[kept] >> np.uint64(40)).astype(np.int64) % shards
            by = np.argsort(bucket, kind="stable")
            occ = np.argsort(bucket[of], kind="stable")
            cuts = np.searchsorted(bucket[by], np.unique(bucket))
            ends = np.append(cuts[1:], len(by))
            o_cuts = np.searchsorted(bucket[of][occ], np.unique(bucket))
            o_ends = np.append(o_cuts[1:], len(occ))
            place = np.empty(len(kept), dtype=np.int64)
            table, whose = np.unique(np.stack([doc, key]), axis=1, return_inverse=True)
            whose, out = whose.reshape(-1), []
            for x, y, u, v in zip(cuts, ends, o_cuts, o_ends, strict=True):
                own, rows_ = by[x:y], occ[u:v]
                place[own] = np.arange(len(own))
                at = order[rows_]
                mine, row = np.unique(whose[at], return_inverse=True)
                k = kept[own]
                out.append((int(bucket[own[0]]), anchor[k].tobytes(), V.squeeze(b"".join([texts[i] for i in k.tolist()])), _packed_numbers(length[k], place[of[rows_]], row, pos[at], table[0][mine], table[1][mine])))
            return C.batch_of(ENTRY_NAMES, [list(x) for x in zip(*out, strict=True)], [pa.int32()] + [pa.binary()] * 3)

        for batch in batches:
            for piece in C.slices(batch, V.PIECE):
                s = Stretches(C.raw(piece), width)
                some = np.flatnonzero(V.Sketch.repeated(twice.value, sketch_bits, s.anchor))
                if not len(some):
                    continue
                start, end, d, anchor = s.start[some], s.end[some], s.doc[some], s.anchor[some]
                if (many := np.isin(anchor, common.value)).any():  # spread over as many shards as there are windows
                    n_windows = end[many] - start[many] - width + 1
                    each = C.ranges(start[many], n_windows)
                    d = np.concatenate([d[~many], np.repeat(d[many], n_windows)])
                    start, end = np.concatenate([start[~many], each]), np.concatenate([end[~many], each + width])
                    anchor = np.concatenate([anchor[~many], s.rolling.of(each, each + width)])
                doc = piece.column("doc_id").to_numpy(zero_copy_only=False)
                key = piece.column("key").to_numpy(zero_copy_only=False)
                whole = s.t.tobytes()
                held.append((anchor, s.rolling.of(start, end), end - start, doc[d], key[d], start - s.off[d], [whole[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]))
                size += len(start)
                if size >= GATHERED:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def settle(batches):
        held, bucket, out = [], None, V.Outbox(n)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ENTRY_NAMES), strict=True):
                if row[0] != bucket and held:
                    out.add(*_settled(held, width))
                    held = []
                bucket = row[0]
                held.append(row[1:])
            yield from out.full()
        if held:
            out.add(*_settled(held, width))
        yield from out.rest()

    spans = read.mapInArrow(C.tidied(gather), ENTRIES).repartition(C.parts(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(C.tidied(settle), V.SPANS)
    runs = V.runs_by_document(spans)

    def keep(piece):
        out = []
        for text, starts, lens in zip(C.raw(piece), piece.column("starts").to_pylist(), piece.column("lens").to_pylist(), strict=True):
            a, e = V.covered(starts, lens, width)
            edges = [0, *np.stack([a, e], axis=1).reshape(-1).tolist(), len(text)]
            kept = b"".join([text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)])
            out.append((len(text), len(text) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), kept))
        return C.batch_of(["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"], [C.ids(piece), *[list(x) for x in zip(*out, strict=True)]], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()])

    joined = rows.join(runs, ["doc_id", "key"], "left")
    return C.map_slices(joined, keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary")
