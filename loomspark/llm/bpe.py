"""Byte-level BPE encoding and decoding: speculate and verify.

Greedy longest match proposes the tokens of every new word of a batch at once. BPE's output is the only token sequence
whose adjacent pairs could each have come about side by side, so a vectorised check of every adjacent pair decides;
words with a failing pair (or with a proposed token that merging never makes) are merged exactly.
"""

from __future__ import annotations

import hashlib
import json
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common as C

#: Fixed values of the byte-level format: white space and the split of a text into words.
SPACE = r"\t\n\x0B\x0C\r\x20\x85\xA0  -     　"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Where a text may be cut without changing its words: before a space that something other than white space follows.
UNEVEN = regex.compile(rf" (?=[{SPACE}]|$)")
CUT = regex.compile(rf"(?= [^{SPACE}])", flags=regex.V1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where visible, else the next one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {s: b for b, s in enumerate(byte_symbols())}
        vocab = spec["model"]["vocab"]
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]))
        for s, k in vocab.items():
            self.bytes_of[k] = bytes(back[c] for c in s)
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for s, k in self.special.items():
            self.bytes_of[k] = s.encode()
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.single = np.array([vocab.get(s, -1) for s in byte_symbols()], dtype=np.int64)
        size = len(self.bytes_of)
        left, right, self.rank = np.full(size, -1), np.full(size, -1), {}
        made = np.full(size, -1)
        for r, (a, b) in enumerate(spec["model"]["merges"]):
            pair = vocab[a], vocab[b]
            k = vocab[a + b]
            self.rank[pair] = r, k
            if made[k] < 0:
                made[k], left[k], right[k] = r, *pair
        self.left, self.right, self.made = left, right, made
        self.rank_to = np.array([k for _, k in self.rank.values()], dtype=np.int64)
        codes = np.array([a * size + b for a, b in self.rank], dtype=np.int64)
        order = np.argsort(codes)
        self.pair_codes, self.pair_ranks, self.size = codes[order], np.array([r for r, _ in self.rank.values()], dtype=np.int64)[order], size
        #: Tokens that merging their own bytes yields; others are never accepted from the proposal.
        self.sound = np.zeros(size, dtype=bool)
        usable = {self.bytes_of[k]: k for k in vocab.values() if self.bytes_of[k]}
        self._trie(usable)
        own = np.array(sorted(usable.values()))
        self.sound[own] = [made[k] < 0 and len(self.bytes_of[k]) == 1 for k in own]
        own = own[made[own] >= 0]
        self.sound[own] = self._apart_ok(left[own], right[own], made[own])
        for k in sorted(usable.values(), key=lambda k: made[k]):  # a part that is unsound makes the whole unsound
            if made[k] >= 0:
                self.sound[k] &= self.sound[left[k]] and self.sound[right[k]]
        self.words, self.spaced = C.Remembered(8 << 20), C.Remembered(96 << 20)  # chunks, and chunks behind a space
        self.counts = {"proposed": 0, "merged": 0}

    def _trie(self, usable: dict[bytes, int]) -> None:
        """Edges (node * 256 + byte) in a sorted array, their targets, and the token that ends at each node."""
        nodes, edges, token = {b"": 0}, {}, [-1]
        for s, k in usable.items():
            for n in range(1, len(s) + 1):
                if s[:n] not in nodes:
                    nodes[s[:n]] = len(token)
                    edges[nodes[s[: n - 1]] * 256 + s[n - 1]] = len(token)
                    token.append(-1)
            token[nodes[s]] = k
        keys = np.fromiter(edges, dtype=np.int64, count=len(edges))
        order = np.argsort(keys)
        self.edge_keys, self.edge_to = keys[order], np.fromiter(edges.values(), dtype=np.int64, count=len(edges))[order]
        self.token_at = np.array(token, dtype=np.int64)

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
        return np.where(self.pair_codes[at] == code, self.pair_ranks[at], 1 << 40)

    def _apart_ok(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | int = 1 << 40) -> np.ndarray:
        """Whether tokens a and b can stand side by side: no merge ever crosses the border between them.

        Undoing the merges beside the border from the last one back shows each pair of parts that met there, and until
        when: a crossing merge of a lower rank than the merge that used up the left part, or at most that of the
        right part (equal pairs merge from the left), would have come first. `before`: merges of this rank and later
        do not count.
        """
        x, y = a.copy(), b.copy()
        end_x = np.broadcast_to(np.asarray(before, dtype=np.int64), len(a)).copy()
        end_y, limit = end_x.copy(), end_x.copy()
        ok, open_ = np.ones(len(a), dtype=bool), np.arange(len(a))
        while len(open_):
            i = open_
            r = self._pair_rank(x[i], y[i])
            bad = (r < end_x[i]) & (r <= end_y[i]) & (r < limit[i])
            ok[i[bad]] = False
            i = i[~bad]
            mx, my = self.made[x[i]], self.made[y[i]]
            i, mx, my = (v[(mx >= 0) | (my >= 0)] for v in (i, mx, my))
            undo_x = mx > my  # equal: the left one merged first, so the right one is undone first
            k = i[undo_x]
            end_x[k] = self.made[x[k]]
            x[k] = self.right[x[k]]
            k = i[~undo_x]
            end_y[k] = self.made[y[k]]
            y[k] = self.left[y[k]]
            open_ = i
        return ok

    def _propose(self, text: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words at once: (word, token) in order of the text."""
        n = len(off) - 1
        start, stop = off[:-1].copy(), off[1:]
        at, node = start.copy(), np.zeros(n, dtype=np.int64)
        best, best_end = np.full(n, -1), start.copy()
        live = np.flatnonzero(start < stop)
        words, tokens, places = [], [], []
        while len(live):
            inside = at[live] < stop[live]
            key = node[live] * 256 + text[np.minimum(at[live], len(text) - 1)]
            e = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            moves = inside & (self.edge_keys[e] == key)
            go = live[moves]
            node[go] = self.edge_to[e[moves]]
            at[go] += 1
            got = go[self.token_at[node[go]] >= 0]
            best[got], best_end[got] = self.token_at[node[got]], at[got]
            halt = live[~moves]
            if len(halt):  # the longest match is known: it is proposed, and the search goes on behind it
                words.append(halt)
                tokens.append(best[halt].copy())
                places.append(start[halt].copy())
                start[halt] = np.maximum(best_end[halt], start[halt] + (best[halt] < 0))
                at[halt], best_end[halt], best[halt], node[halt] = start[halt], start[halt], -1, 0
                live = live[start[live] < stop[live]]
        if not words:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        w, t, p = np.concatenate(words), np.concatenate(tokens), np.concatenate(places)
        order = np.lexsort((p, w))
        return w[order], t[order]

    def _merge_all(self, words: list[bytes]) -> list[np.ndarray]:
        """Exact merging of many short words side by side: in each round every word merges its leftmost pair of lowest rank."""
        out: list = [None] * len(words)
        text, off = C.joined(words)
        tok, word = self.single[text], np.repeat(np.arange(len(words)), np.diff(off))
        while len(tok):
            code = tok[:-1] * self.size + tok[1:]
            at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
            rank = np.full(len(tok), 1 << 40)
            rank[:-1] = np.where((self.pair_codes[at] == code) & (word[:-1] == word[1:]), self.pair_ranks[at], 1 << 40)
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            counts = np.diff(np.append(begins, len(tok)))
            low = np.minimum.reduceat(rank, begins)
            ended = low == 1 << 40
            for k in np.flatnonzero(ended).tolist():
                out[word[begins[k]]] = tok[begins[k] : begins[k] + counts[k]]
            spot = np.flatnonzero((rank == np.repeat(low, counts)) & (rank < 1 << 40))
            spot = spot[np.append(True, word[spot[1:]] != word[spot[:-1]])] if len(spot) else spot
            tok[spot] = self.rank_to[rank[spot]]
            keep = ~np.repeat(ended, counts)
            keep[spot + 1] = False
            tok, word = tok[keep], word[keep]
        return out

    def _merge_long(self, word: bytes) -> list[int]:
        """Exact merging of a long word in n log n steps: a heap of pairs over a linked list."""
        import heapq

        tok = [int(self.single[b]) for b in word]
        nxt, prev = list(range(1, len(tok) + 1)), list(range(-1, len(tok) - 1))
        heap = [(*self.rank[p], k, *p) for k, p in enumerate(zip(tok, tok[1:])) if p in self.rank]
        heap = [(r, k, a, b, m) for r, m, k, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, m = heapq.heappop(heap)
            j = nxt[k]
            if tok[k] != a or j >= len(tok) or tok[j] != b:
                continue
            tok[k], tok[j] = m, -1
            nxt[k] = nxt[j]
            if nxt[k] < len(tok):
                prev[nxt[k]] = k
            for x in (prev[k], k):
                if x >= 0 and nxt[x] < len(tok) and (p := (tok[x], tok[nxt[x]])) in self.rank:
                    r, m2 = self.rank[p]
                    heapq.heappush(heap, (r, x, *p, m2))
        return [t for t in tok if t >= 0]

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, which no merge leaves."""
        if not words:
            return []
        text, off = C.joined(words)
        w, t = self._propose(text, off)
        good = np.ones(len(words), dtype=bool)
        unsound = (t < 0) | ~self.sound[np.maximum(t, 0)]
        good[w[unsound]] = False
        side = np.flatnonzero(w[1:] == w[:-1])
        if len(side):
            pairs, where = np.unique(t[side] * self.size + t[side + 1], return_inverse=True)
            valid = pairs >= 0
            ok = np.zeros(len(pairs), dtype=bool)
            ok[valid] = self._apart_ok(pairs[valid] // self.size, pairs[valid] % self.size)
            good[w[side[~ok[where]]]] = False
        bounds = np.searchsorted(w, np.arange(len(words) + 1)).tolist()
        out = [t[a:b] for a, b in zip(bounds, bounds[1:])]
        failed = np.flatnonzero(~good).tolist()
        short = [k for k in failed if len(words[k]) < 64]
        for k, got in zip(short, self._merge_all([words[k] for k in short]), strict=True):
            out[k] = got
        for k in failed:
            if len(words[k]) >= 64:
                out[k] = np.array(self._merge_long(words[k]), dtype=np.int64)
        self.counts["proposed"] += len(words)
        self.counts["merged"] += len(failed)
        return out

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks, as little-endian 32-bit integers; a chunk is cut into words first."""
        cut = [WORD.findall(c) for c in chunks]
        distinct = list(dict.fromkeys(x for c in cut for x in c))
        got = dict(zip(distinct, (k.astype("<u4").tobytes() for k in self.encode_words([x.encode() for x in distinct])), strict=True))
        return [b"".join(map(got.__getitem__, c)) for c in cut]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        plans, new, new_spaced = [], set(), set()
        for text in texts:
            plan = []
            for k, part in enumerate(self.apart.split(text) if self.apart and any(s in text for s in self.special) else [text]):
                if k % 2:
                    plan.append((part, None))
                    continue
                if not part:
                    continue
                if UNEVEN.search(part):
                    bits = [b for b in CUT.split(part) if b]
                    plan.append((bits, []))
                    new.update(bits)
                else:
                    head, *tail = part.split(" ")
                    plan.append(([head] if head else [], tail))
                    if head:
                        new.add(head)
                    new_spaced.update(tail)
            plans.append(plan)
        fresh = self.words.missing(new)
        self.words.learn(dict(zip(fresh, self._learn(fresh), strict=True)))
        fresh = self.spaced.missing(new_spaced)
        self.spaced.learn(dict(zip(fresh, self._learn([" " + x for x in fresh]), strict=True)))
        one, two = self.words.new.__getitem__, self.spaced.new.__getitem__
        out = []
        for plan in plans:
            got = []
            for bits, tail in plan:
                if tail is None:
                    got.append(int(self.special[bits]).to_bytes(4, "little"))
                else:
                    got.extend(map(one, bits))
                    got.extend(map(two, tail))
            out.append(b"".join(got))
        return out

    def decode(self, ids: bytes) -> str:
        """Special tokens stay; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


@cache
def load(path: str) -> Bpe:
    return Bpe(path)


ENCODED = "doc_id long, n_tokens long, ids binary"


def encode(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), one row for each row of docs, repeated rows too.

    Null text counts as empty and has no ids; texts are encoded whole; an empty table gives an empty result. Other columns
    of docs, whatever their names, are not read.
    """
    path = C.vocabulary_path(tokenizer)

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        got = load(path).encode_batch([x or "" for x in piece.column("text").to_pylist()])
        return C.batch_of(["doc_id", "n_tokens", "ids"], [C.ids(piece), [len(x) // 4 for x in got], got], [pa.int64(), pa.int64(), pa.binary()])

    return C.map_slices(C.texts(docs), run, ENCODED)


def decode(encoded: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, text of rows with doc_id and ids; null ids give an empty text."""
    path = C.vocabulary_path(tokenizer)

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        return C.batch_of(["doc_id", "text"], [C.ids(piece), [bpe.decode(x or b"") for x in piece.column("ids").to_pylist()]], [pa.int64(), pa.string()])

    def all_(batches):
        for batch in batches:
            for piece in C.slices(batch, 4 * C.STEP_BYTES, "ids"):
                yield run(piece)

    return encoded.select("doc_id", "ids").mapInArrow(C.tidied(all_), "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes in one pass, one row for each row of docs.

    Null text counts as empty (no ids); texts are encoded whole. Repeated rows give repeated results; an empty table an
    empty one. Other columns of docs, whatever their names, are not read.
    """
    path = C.vocabulary_path(tokenizer)

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        got = bpe.encode_batch([x or "" for x in piece.column("text").to_pylist()])
        back = [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in got]
        return C.batch_of(["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [C.ids(piece), [len(x) // 4 for x in got], [hashlib.sha256(x).hexdigest() for x in got], back], [pa.int64(), pa.int64(), pa.string(), pa.string()])

    return C.map_slices(C.texts(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
