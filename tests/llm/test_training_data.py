"""The training-data operators against brute force, on edge cases that hold nulls, ties, repeats and clashing columns."""

import glob
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import bpe, components, decontaminate, exact, language, lm, quality, queries, simhash, substrings, suffixes, tokenfile
from loomspark.llm.common import vocabulary_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, digest string, key long, score double, n int"
EDGES = [None, "", " \n\t ", "a", "The the", "x" * 20_000, "word " * 15_000, "é漢字🙂 naïve Ünïcode\x00\x1c", "<|endoftext|> <|startoftext|>"]


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def frame(spark, texts, parts=3):
    """Documents with extra columns whose names operators use themselves."""
    rows = [(k, t, ["en", None, "fr"][k % 3], None, "x", 1, None, 2) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def corpus(seed=0, n=60):
    """Texts with shared passages, near and exact copies, repeats."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(80)]
    say = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    shared = [say(30) for _ in range(3)]
    out = []
    for k in range(n):
        t = say(r.randint(5, 90))
        if k % 4 == 0:
            t += " " + shared[k % 3] + ".\n" + say(9)
        if k % 9 == 0 and out:
            t = out[-1]
        if k % 11 == 0 and out:
            t = out[0].replace(" a", " b", 1) + " tail"
        out.append(t)
    return out + EDGES + [out[5], None, ""]


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.01")])
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name, sf):
    if not os.path.isdir(sf):
        pytest.skip("test tables are not here")
    c = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df, want = queries.QUERIES[name](spark, sf), c.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(x) for x in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (quality.quality_scores(empty, labels), bpe.round_trip(empty), simhash.simhash_components(empty), language.identify(empty), suffixes.byte_dedup(empty), substrings.word_window_dedup(empty), lm.score_documents(empty), decontaminate.decontaminate(empty, bench), exact.exact_dedup(empty), tokenfile.token_index(empty)):
        assert out.count() == 0


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "same text here", None), (7, "same text here", None), (7, "same text here", None), (3, "same text here", "en"), (7, "other", "en"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = exact.exact_dedup(df).collect()
    same = [r for r in got if r.group_size == 4]
    assert len(got) == 6 and len(same) == 4 and {r.keep_id for r in same} == {7} and sum(r.kept for r in same) == 1
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in exact.keep_one_of_equal(df).collect() if r.doc_id) == [(False, 7, "other"), (False, 7, "same text here")]
    labels = spark.createDataFrame([(7, 1), (7, 0), (3, 0), (None, 1)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "text here"), (None, "same"), (2, None)], "item_id long, text string")
    for out in (quality.quality_scores(df, labels), bpe.round_trip(df), simhash.simhash_components(df), language.identify(df), suffixes.byte_dedup(df), substrings.word_window_dedup(df), lm.score_documents(df), decontaminate.decontaminate(df, bench), tokenfile.token_index(df)):
        assert out.count() == 6
    assert {(r.doc_id, r.n_hit) for r in decontaminate.decontaminate(df, bench).collect()} == {(None, 2), (7, 2), (3, 2), (7, 0), (None, 0)}


def test_exact(docs, texts):
    groups = {}
    for k, t in enumerate(texts):
        groups.setdefault(t or "", []).append(k)
    got = {r.doc_id: r for r in exact.exact_dedup(docs).collect()}
    for t, ids in groups.items():
        for k in ids:
            r = got[k]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), k == max(ids), hashlib.sha256(t.encode()).hexdigest())


def test_cuckoo_index_grows_and_forgets():
    index, keys = exact.CuckooIndex(2, 5), [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    for k, d in enumerate(keys):
        index.insert(d, k)
    assert all(index.get(d) == k for k, d in enumerate(keys)) and index.size == 3000
    assert index.delete(keys[5]) and not index.delete(keys[5]) and index.get(keys[5]) is None
    index.insert(keys[5], 9)
    assert index.get(keys[5]) == 9 and index.size == 3000
    twins = [bytes([1, 0, 2, 0, 0, 0, 0, 0]) + bytes([k]) * 24 for k in range(8)]  # one print, one pair of buckets
    for k, d in enumerate(twins):
        index.insert(d, k)
    assert [index.get(d) for d in twins] == list(range(8))


def test_bpe_equals_library(docs, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    for k, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(want, skip_special_tokens=False)
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(want), hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_bpe_fuzz_and_round_trip(spark):
    from tokenizers import Tokenizer

    library, own, r = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json")), bpe.load(vocabulary_path("byte_bpe_50k.json")), random.Random(3)
    alphabet = [*" \n\t  \x85\x1caeiouthst'é漢🙂.,!-_AAAA", " the", "'re", "  ", "<|endoftext|>", "aaaaaaaa"]
    made = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(2000)]
    for t, got in zip(made, own.encode_batch(made), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
        assert own.decode(got) == t
    df = frame(spark, made[:50])
    assert {r.doc_id: r.text for r in bpe.decode(bpe.encode(df)).collect()} == dict(enumerate(made[:50]))


def test_simhash_prints_and_components(docs, texts):
    import xxhash

    prints = []
    for t in texts:
        w = words(t)
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), seed=42) for k in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: r for r in simhash.simhash_components(docs).collect()}
    assert all((got[k].fingerprint, got[k].component_id) == (f"{prints[k]:016x}", root(k)) for k in range(len(texts)))


def similar_roots(texts, ids):
    """Of each id the smallest id that links of a Jaccard similarity of 0.8 on five-word shingles lead to."""
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := texts[k].encode().lower().split()) else set() for k in ids}
    parent = {k: k for k in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if b < a and (texts[a] == texts[b] or both >= 0.8 * len(sets[a] | sets[b])):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in ids}


def near_copies(seed=11, groups=6, copies=8):
    """Long texts with copies of one changed word each, and texts of like words in another order."""
    r = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"w{r.randrange(400)}" for _ in range(220)]
        for _ in range(copies):
            w = list(base)
            w[r.randrange(len(w))] = f"new{r.randrange(9)}"
            out.append(" ".join(w))
        r.shuffle(base)
        out.append(" ".join(base))
    return out


def test_near_copies_are_verified(spark):
    texts = near_copies()
    want = similar_roots(texts, range(len(texts)))
    got = {r.doc_id: r.component_id for r in simhash.similar_components(frame(spark, texts)).collect()}
    assert all(want[k] == want[c] for k, c in got.items())  # nothing is linked that is not alike
    assert sum(got[k] == want[k] for k in want) >= 0.9 * len(want)
    kept = simhash.keep_one_of_near(frame(spark, texts))
    assert {r.doc_id for r in kept.collect()} == set(got.values()) and "digest" in kept.columns


def candidate_roots(texts):
    """Of each id the smallest id that links of a similarity of 0.8 or more lead to."""
    n = range(len(texts))
    words = [t.encode().lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    root = list(n)
    for a in n:
        for b in range(a):
            if root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    return dict(zip(n, root, strict=True))


def moved(r, words, moves, new=0):
    """A copy with words exchanged, which keeps the fingerprint, and `new` words replaced."""
    w = list(words)
    at = r.sample(range(0, len(w), 6), 2 * moves + new)
    for a, b in zip(at[:moves], at[moves : 2 * moves], strict=True):
        w[a], w[b] = w[b], w[a]
    for a in at[2 * moves :]:
        w[a] = f"new{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("block", [512, 60])
def test_near_copies_of_a_crowd(spark, monkeypatch, block):
    """Copies alike to one text and not to each other, on crowded keys: the closest links fail, others hold."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(5)
    hub = [f"w{k}" for k in range(451)]
    texts = [moved(r, hub, 3, 2) for _ in range(400)] + [" ".join(hub)]
    assert len({simhash.word_fingerprints(t.encode())[0] for t in texts}) > 16
    want = candidate_roots(texts)
    assert max(Counter(want.values()).values()) > 300
    assert {x.doc_id: x.component_id for x in simhash.similar_components(frame(spark, texts)).collect()} == want


def test_near_copies_of_one_fingerprint(spark):
    """Texts of the same distinct words, of which the head is like none or few of the others."""
    r = random.Random(8)
    texts = []
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(300)]
        hub = " ".join(base)
        other = r.sample(base, len(base))
        near = [moved(r, base, 2) for _ in range(6)]
        texts += [" ".join(other), hub, *near[: g % 6 + 1], *([moved(r, other, 1)] if g % 2 else [])]
    assert len({simhash.word_fingerprints(t.encode())[0] for t in texts}) <= 12
    want = candidate_roots(texts)
    assert {x.doc_id: x.component_id for x in simhash.similar_components(frame(spark, texts)).collect()} == want


def test_pairs_over_one_vocabulary(spark):
    """Thirty pairs of near copies whose texts all have the same words: every pair is found, nothing else."""
    r = random.Random(11)
    vocabulary = [f"v{k}" for k in range(240)]
    texts = []
    for _ in range(30):
        one = r.sample(vocabulary, len(vocabulary))
        two = list(one)
        two[-1], two[-2] = two[-2], two[-1]
        texts += [" ".join(one), " ".join(two)]
    got = {x.doc_id: x.component_id for x in simhash.similar_components(frame(spark, texts)).collect()}
    assert got == {k: k - k % 2 for k in range(60)}


def test_two_thousand_members_of_a_key(spark):
    """One fingerprint with 2000 texts in a thousand pairs, and one with 2000 copies of a hub: no link is lost."""
    r = random.Random(12)
    vocabulary = [f"v{k}" for k in range(60)]
    texts = []
    for _ in range(1000):
        one = r.sample(vocabulary, len(vocabulary))
        texts += [" ".join(one), " ".join([*one[:-2], one[-1], one[-2]])]
    hub = [f"h{k}" for k in range(300)]
    texts += [" ".join(hub), *(moved(r, hub, 2) for _ in range(2000))]
    got = {x.doc_id: x.component_id for x in simhash.similar_components(frame(spark, texts)).collect()}
    assert all(got[k] == k - k % 2 for k in range(2000))
    hubs = [t.split() for t in texts[2000:]]
    near = {tuple(hubs[0][i : i + 5]) for i in range(296)}
    like = [len(near & (own := {tuple(w[i : i + 5]) for i in range(296)})) / len(near | own) for w in hubs]
    assert sum(x >= 0.8 for x in like) > 1500 and all(got[2000 + k] == 2000 for k, x in enumerate(like) if x >= 0.8)


def test_near_copies_of_few_distinct_words(spark):
    """Texts of 120 words over few distinct ones, and copies with a new word: fingerprints differ a lot, no link is lost."""
    r, texts = random.Random(13), []
    for k in range(160):
        own = ["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range((2, 5, 12, 40)[k % 4])]
        w = [r.choice(own) for _ in range(120)]
        texts += [" ".join(w), " ".join([*w[:60], f"new{k}", *w[60:]])]
    texts += ["one two three", "One  two three", "one two", "one"]
    want = candidate_roots(texts)
    assert sum(want[k] != k for k in want) > 100
    assert {x.doc_id: x.component_id for x in simhash.similar_components(frame(spark, texts)).collect()} == want


def test_recall_of_near_copies(spark):
    """Of all pairs with a similarity of 0.8 or more, found by their rarest common shingles, 99 of 100 are in one component."""
    if not os.path.isdir("/root/testdata/sf0.1"):
        pytest.skip("test tables are not here")
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    texts = {t: k for k, t in df.orderBy(F.desc("doc_id")).collect()}
    texts = {k: t for t, k in texts.items() if t}
    sets = {k: set(simhash.shingle_set(t.encode(), 5).tolist()) for k, t in texts.items()}
    times = Counter(x for own in sets.values() for x in own)
    filed, pairs = {}, []
    for k in sorted(sets, key=lambda k: len(sets[k])):
        own = sorted(sets[k], key=lambda x: (times[x], x))
        for j in {j for x in own[: len(own) - math.ceil(0.8 * len(own)) + 1] for j in filed.get(x, ())}:
            if len(sets[j] & sets[k]) >= 0.8 * len(sets[j] | sets[k]):
                pairs.append((j, k))
        for x in own[: len(own) - math.ceil(0.8 * len(own)) + 1]:
            filed.setdefault(x, []).append(k)
    got = {r.doc_id: r.component_id for r in simhash.similar_components(df).collect()}
    assert len(pairs) > 40 and sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)


def test_names_that_clash_with_helpers(spark):
    rows = [(1, "a b c d e f g", 1, 1, 1, 1, 1, 1), (2, "a b c d e f g", 2, 2, 2, 2, 2, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, kept int, n int, __id int, __row int, mark int")
    assert simhash.keep_one_of_near(df).collect() == [rows[0]]
    assert exact.keep_one_of_equal(df).collect() == [rows[1]]


def test_near_copies_of_odd_rows(spark, empty, docs, texts):
    assert simhash.keep_one_of_near(empty).count() == 0
    got = {r.doc_id: r.component_id for r in simhash.similar_components(docs).collect()}
    whole = similar_roots([t or "" for t in texts], range(len(texts)))
    assert len(got) == len(texts) and all(whole[k] == whole[c] for k, c in got.items())  # nothing is linked that is not alike
    rows = spark.createDataFrame([(None, "a b c d e f g"), (7, "a b c d e f g"), (7, "z y x"), (2, None), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in simhash.keep_one_of_near(rows).collect()) == [(False, 2), (False, 7), (False, 7)]


@pytest.mark.parametrize("crowd", [2048, 10])
def test_near_links_of_crowds(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    r = random.Random(4)
    made = set()
    for _ in range(4):
        center = r.getrandbits(64)
        for _ in range(150):
            x = center
            for b in r.sample(range(64), r.randint(0, 4)):
                x ^= 1 << b
            made.add(x)
    made = sorted(made)
    at = {x: k for k, x in enumerate(made)}

    def merged(pairs):
        parent = list(range(len(made)))

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in pairs:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
        return [root(k) for k in range(len(made))]

    want = merged((a, b) for a in range(len(made)) for b in range(a) if (made[a] ^ made[b]).bit_count() <= 3)
    got = simhash.near_links(spark.createDataFrame([(simhash.signed(x),) for x in made], "print long")).collect()
    assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= 3 for r in got)
    assert merged((at[r.a % (1 << 64)], at[r.b % (1 << 64)]) for r in got) == want


def test_links_by_flips_equal_links_by_pairs():
    r = np.random.default_rng(5)
    fp = np.unique(r.integers(0, 1 << 14, 6000, dtype=np.uint64))

    def merged(pairs):
        parent = list(range(len(fp)))

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in pairs:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
        return [root(k) for k in range(len(fp))]

    for wild in (0, 3):
        flips = simhash.links(fp, 1, wild)
        side = (fp >> np.uint64(max(wild - 1, 0))) & np.uint64(1)
        pairs = [(i, j) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp[i + 1 :]) <= 1) + i + 1 if not wild or side[i] != side[j]]
        assert merged(flips) == merged(pairs)


def test_components_of_a_long_chain(spark):
    pairs = [(k, k + 1) for k in range(200)] + [(1000, 1003), (1003, 1001), (5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(201)} | {k: 1000 for k in (1000, 1001, 1003)}


def test_language_held_out(spark):
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("test tables are not here")
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97


def test_language_of_texts_without_letters(docs, texts):
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    for k, t in enumerate(texts):
        assert (got[k].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.lang_pred != "und" for r in got.values())


def test_language_keeps_texts_where_none_is_known(spark):
    rows = spark.createDataFrame([(1, "clean text", None), (2, None, None), (3, "12 !", None), (4, "", None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in language.keep_known(rows).collect()] == [1]


def test_language_backs_off():
    model = language.LanguageModel([("en", "night", 9), ("de", "nacht", 9)])
    nightly, nachts, none = model.scores(["nightly", "nachts", "漢"])
    assert nightly.argmax() == model.langs.index("en") and nachts.argmax() == model.langs.index("de") and not none.any()


def test_language_scores_by_hand(spark, texts):
    """Counts, back-off and shares written out one by one."""
    rows = [(k, t, ["en", "fr", None, "de"][k % 4]) for k, t in enumerate(texts)] + [(k, f"unseen{k} wörter and tokens", None) for k in range(900, 930)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    cut = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    langs, tables = ["de", "en", "fr"], {n: {} for n in (0, 5, 4, 3, 2, 1)}
    parts = lambda w, n: [w] if n == 0 else list(w) if n == 1 else [f"\2{w}\3"[i : i + n] for i in range(len(w) + 3 - n)]
    for k, t, lang in rows:
        if lang and t and zlib.crc32(str(k).encode()) % 5:
            for w in cut(t):
                for n, table in tables.items():
                    for g in parts(w, n):
                        table.setdefault(g, Counter())[lang] += 1
    sums = {n: Counter() for n in tables}
    for n, table in tables.items():
        for c in table.values():
            sums[n].update(c)
    log = lambda n, g, lang: math.log((tables[n][g][lang] + 0.5) / (sums[n][lang] + 0.5 * (len(tables[n]) + 1)))
    got = {r.doc_id: r for r in language.identify(df).collect()}
    for k, t, _ in rows:
        if not t or not any(c.isalpha() for c in t) or k % 7 and len(t) > 5000:
            continue
        total = dict.fromkeys(langs, 0.0)
        for w, times in Counter(cut(t)).items():
            for n in tables:
                known = [g for g in parts(w, n) if g in tables[n]]
                if known:
                    for lang in langs:
                        total[lang] += times * sum(log(n, g, lang) for g in known) / len(known)
                    break
        best = max(langs, key=lambda x: (total[x], [-ord(c) for c in x]))
        share = 1 / sum(math.exp(min(700, total[x] - total[best])) for x in langs)
        assert got[k].score == pytest.approx(share, rel=1e-3, abs=1e-6), (k, t)
        if share > 0.5 + 1e-6:
            assert got[k].lang_pred == best


def test_remembered_parts_are_bounded():
    from loomspark.llm.common import Remembered

    known = Remembered(1 << 16)
    for k in range(40):
        keys = {"often", *(f"{k}-{j}" for j in range(50))}
        missing = known.missing(keys)
        assert ("often" in missing) == (k == 0) and keys - set(missing) <= known.new.keys()
        known.learn({x: b"v" for x in missing})
        assert len(known.new) + len(known.old) < (1 << 16) / Remembered.EACH + 60


def test_word_windows_tell_complementary_words_apart(spark):
    """Two words whose polynomial hashes modulo 2 ** 64 are equal for any base."""
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{k}" for k in range(12))
    other = one.translate(str.maketrans("ab", "ba"))
    texts = [f"{w} {tail}" for x in (one, other) for w in (x, x[:200], x[:256], x[:257])] + [f"{one} {tail}"]
    got = sorted((r.doc_id, r.n_removed) for r in substrings.word_window_dedup(frame(spark, texts)).collect())
    assert got == [(k, 0) for k in range(8)] + [(8, 13)]


def test_byte_dedup(docs, texts):
    first, raw = {}, [(t or "").encode() for t in texts]
    for k, b in enumerate(raw):
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], k)
    got = {r.doc_id: r for r in suffixes.byte_dedup(docs).collect()}
    for k, b in enumerate(raw):
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < k:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())


def test_suffix_arrays_and_prefixes(monkeypatch):
    r = random.Random(6)
    for limit in (1024, 0):
        monkeypatch.setattr(suffixes, "ALPHABET", limit)
        for case in range(120):
            t = [r.randrange(r.choice([1, 2, 4, 200])) for _ in range(r.randint(1, 120))]
            t = t * 3 if case % 5 == 0 else t
            sa = suffixes.suffix_array(np.array(t, dtype=np.uint16))
            assert sa.tolist() == sorted(range(len(t)), key=lambda k: t[k:])
            lcp = suffixes.common_prefixes(np.array(t, dtype=np.uint16), sa)
            for a, b in zip(sa.tolist(), sa.tolist()[1:]):
                n = 0
                while max(a, b) + n < len(t) and t[a + n] == t[b + n]:
                    n += 1
                assert lcp[b] == n


def test_induction_sorts_every_level(monkeypatch):
    """On text of a shard's kind the reduced strings have large alphabets; they too are sorted by induction alone."""
    r, sizes, each = random.Random(7), [], suffixes._induce_each
    monkeypatch.setattr(suffixes, "_induce_each", lambda s, small, leftmost, counts: sizes.append(len(counts)) or each(s, small, leftmost, counts))
    words_ = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(3000)]
    half = " ".join(r.choice(words_) for _ in range(5000))
    text = (half + "\n" + half[7000:20000] + "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" + half).encode()
    assert suffixes.suffix_array(np.frombuffer(text, dtype=np.uint8)).tolist() == sorted(range(len(text)), key=lambda k: text[k:])
    assert sizes and max(sizes) > 1024


def test_names_of_substrings_at_the_width_of_a_key():
    """Substrings whose lengths are multiples of the symbols in a key, beside longer ones that begin alike."""
    r = random.Random(12)
    for case in range(200):
        symbols = r.choice([3, 5, 256])
        per = 63 // symbols.bit_length()
        stems = [[r.randrange(2, min(symbols, 4)) for _ in range(3 * per)] for _ in range(2)]
        cuts, s = [], []
        for _ in range(r.randint(2, 40)):
            cuts.append(len(s))
            s += r.choice(stems)[: r.choice([per - 1, per, per + 1, 2 * per - 1, 2 * per, 2 * per + 1, 3 * per]) - 1]
        cuts.append(len(s))
        s = np.array([*s, 0])
        got = suffixes._names(s, np.array(cuts, dtype=np.int32), symbols)
        parts = [tuple(s[a : b + 1].tolist()) + (symbols,) for a, b in zip(cuts, cuts[1:])] + [(0, symbols)]
        want = {x: k for k, x in enumerate(sorted(set(parts)))}
        assert got.tolist() == [want[x] for x in parts], case


def test_suffix_arrays_of_real_text():
    """Shards as operator 5 makes them: 10 ** 5 bytes of the test documents, every suffix against the next."""
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    rows = duckdb.sql(f"select text from '{SF}/documents.parquet' where text is not null order by doc_id").fetchall()
    whole = "\0".join(r[0] for r in rows).encode()
    for start in (0, 100_000):
        t = whole[start : start + 100_000]
        sa = suffixes.suffix_array(np.frombuffer(t, dtype=np.uint8))
        assert sorted(sa.tolist()) == list(range(len(t))) and all(t[a:] < t[b:] for a, b in zip(sa.tolist(), sa.tolist()[1:]))


def test_equal_prints_of_different_stretches(monkeypatch):
    """Bytes decide: with a hash that is always the same, nothing else is removed."""
    a, b = b"x" * 60, b"y" * 60
    order = np.array([0, 2, 1])
    same = np.zeros(3, dtype=np.uint64)
    assert suffixes._distinct(order, [same, same], [a, b, a]).tolist() == [True, False, True]


def test_word_window_dedup(docs, texts):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    first = {}
    for k, w in enumerate(split):
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), k)
    got = {r.doc_id: r for r in substrings.word_window_dedup(docs).collect()}
    for k, w in enumerate(split):
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < k for j in range(i, i + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[k].n_words, got[k].n_removed, got[k].kept_sha256, got[k].kept_text) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)


@pytest.mark.parametrize("op", ["words", "bytes"])
def test_a_full_sketch_changes_nothing(docs, op):
    """With a filter so small that it passes everything, the result is the same."""
    f = substrings.word_window_dedup if op == "words" else suffixes.byte_dedup
    assert sorted(map(tuple, f(docs, sketch_bits=21 if op == "words" else 21).collect())) == sorted(map(tuple, f(docs).collect()))


@pytest.mark.parametrize("op", ["words", "bytes"])
def test_common_anchors_change_nothing(docs, op, monkeypatch):
    """With every anchor held common, the result is the same."""
    from loomspark.llm import windows

    f = substrings.word_window_dedup if op == "words" else suffixes.byte_dedup
    want = sorted(map(tuple, f(docs).collect()))
    monkeypatch.setattr(windows, "LEAST", 1)
    assert sorted(map(tuple, f(docs).collect())) == want


def test_decontamination(spark, docs, texts):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = lambda t: pattern.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    items = {1: texts[0], 12: " ".join(fold(texts[4])[-14:]).upper(), 3: "The the", 4: "", 5: None, 6: "!!!", 30: "a"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for block in (20_000, 2):
        got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench, block_items=block).collect()}
        for k, t in enumerate(texts):
            w, hit, found = fold(t), set(), set()
            for item, said in items.items():
                s = fold(said)
                for n in range(max(1, len(s) - 9) if s else 0):
                    window = s[n : n + 10]
                    for i in range(len(w) - len(window) + 1):
                        if w[i : i + len(window)] == window:
                            hit.update(range(i, i + len(window)))
                            found.add(item)
            names = ",".join(sorted(map(str, found)))
            r = got[k]
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit))
        kept = decontaminate.drop_contaminated(docs, bench, block_items=block)
        assert {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if not r.contaminated} and kept.columns == docs.columns


def test_wu_manber_finds_all():
    r = random.Random(7)
    patterns = list({bytes(r.choice(b"ab ") for _ in range(r.randint(3, 40))) for _ in range(200)})
    text = bytes(r.choice(b"ab ") for _ in range(5000))
    want = sorted((k, p) for p, x in enumerate(patterns) for k in range(len(text)) if text.startswith(x, k))
    assert sorted(decontaminate.WuManber(patterns).search(text)) == want
    assert decontaminate.WuManber([]).search(text) == []


def test_lm_base_and_marginals(docs, texts):
    tokens = {k: [*words(t), None] for k, t in enumerate(texts)}
    c = Counter(w for k, x in tokens.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in x)
    n, v = sum(c.values()), len(c)
    for r in lm.score_documents(docs).collect():
        x = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2, len(x), sum(c[w] > 0 for w in x), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), abs=1e-6)
        assert -math.inf < r.score < 0


def test_lattice_sums_all_segmentations():
    voc = lm.vocabulary(vocabulary_path("piece_bpe_32k.model"))
    logs = np.log(voc.prior, where=voc.prior > 0, out=np.full(len(voc.prior), -np.inf))
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    pieces = {model.id_to_piece(k).encode(): k for k in range(model.get_piece_size()) if voc.prior[k] and not model.is_byte(k)}

    def total(t, at):
        if at == len(t):
            return 1.0
        out = math.exp(logs[voc.byte[t[at]]]) * total(t, at + 1)
        for n in range(1, len(t) - at + 1):
            k = pieces.get(t[at : at + n])
            if k is not None and (at == 0 or not voc.opens[k]):
                out += math.exp(logs[k]) * total(t, at + n)
        return out

    some = [b"a", b"the", b"hello", "né".encode(), b"!?", "▁a".encode()]
    got = lm.word_logs(voc, some, logs)
    assert got == pytest.approx([math.log(total(lm.MARK + w, 0)) for w in some])
    counts = lm.expected_pieces(voc, some, np.ones(len(some)), logs)
    covered = sum(counts[k] * len(p) for p, k in pieces.items()) + sum(counts[k] for k in voc.byte)
    assert covered == pytest.approx(sum(len(lm.MARK + w) for w in some))


def test_token_files(spark, docs, texts, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    want, start = {}, 0
    for k, t in enumerate(texts):
        one = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want[k] = (start, len(one), zlib.crc32(np.array(one, dtype="<u4").tobytes()), one)
        start += len(one)
    where = f"file://{tmp_path}/tokens"
    got = {r.doc_id: r for r in tokenfile.token_index(docs, where=where).collect()}
    assert {k: (r.start, r.n_tokens, r.ids_crc32) for k, r in got.items()} == {k: v[:3] for k, v in want.items()}
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in tokenfile.read_tokens(spark, where).collect()} == {k: v[3] for k, v in want.items()}


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 31, 32])
def test_packing(bits):
    v = np.random.default_rng(bits).integers(0, 1 << bits, 10_001, dtype=np.uint64).astype(np.uint32)
    f = tokenfile.TokenFile(tokenfile.write_file([4, None, 9], [v[:10], v[10:10], v[10:]], bits))
    assert (f.all_ids() == v).all() and (f.document(2) == v[10:]).all() and not len(f.document(1)) and (f.ids(4090, 20) == v[4090:4110]).all()
    assert f.null.tolist() == [0, 1, 0] and tokenfile.bits_for(1 << bits) == bits
    with pytest.raises(ValueError, match="token"):
        tokenfile.TokenFile(b"nothing of the kind")


def test_chunk_encoder_equals_library():
    from tokenizers import Tokenizer

    library, own, r = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json")), tokenfile.encoder(vocabulary_path("word_bpe_49k.json")), random.Random(8)
    alphabet = [*" \n\t  abcdeé漢🙂.,!-_\x85\x1c\x1dßİÀ̀ΣςΑ12﻿", "<|endoftext|>", "'re", "'S"]
    made = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    for t, got in zip(made, own.encode_batch(made), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_quality_held_out(spark):
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("test tables are not here")
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    got = quality.quality_scores(d, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) for r in got)
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95


def test_forest_equals_node_by_node_walk():
    r = np.random.default_rng(9)
    x = r.normal(size=(400, 5))
    y = (x[:, 1] > 0.3).astype(float)
    f = quality.boost(x, y, trees=10, depth=3)
    for row, p in zip(x[:40], f.predict(x[:40]), strict=True):
        raw = f.base
        for node in f.roots:
            while f.left[node] != node:
                node = f.left[node] if row[f.feature[node]] <= f.threshold[node] else f.right[node]
            raw += f.value[node]
        assert p == pytest.approx(1 / (1 + math.exp(-raw)))
    assert ((f.predict(x) >= 0.5) == (y == 1)).mean() > 0.97
    assert quality.boost(x, np.ones(400)).predict(x).min() > 0.9


def test_pipeline_equals_its_stages_by_hand(spark, tmp_path, texts):
    import corpus_pipeline

    frame(spark, texts).select("doc_id", "text", "lang", "source", "n").withColumnRenamed("n", "n_chars").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, texts[8])], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}
    kept = {t: k for k, t in enumerate(texts) if any(c.isalpha() for c in t or "")}  # the largest id of equal texts
    roots = similar_roots([t or "" for t in texts], sorted(kept.values()))
    left = [k for k in roots if roots[k] == k]
    item = [x.decode() for x in decontaminate.folded(texts[8].encode())]
    windows = {tuple(item[k : k + 10]) for k in range(max(1, len(item) - 9))}

    def dirty(t):
        w = [x.decode() for x in decontaminate.folded(t.encode())]
        return any(tuple(w[k : k + 10]) in windows for k in range(len(w)))

    assert got == {k for k in left if not dirty(texts[k])}
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
