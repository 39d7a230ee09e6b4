"""Merkle manifests against a tree written out by hand."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from loomspark.llm import merkle

H = lambda *xs: hashlib.sha256("".join(xs).encode()).hexdigest()


def shown(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(leaves, arity):
    """The root and each leaf's path: (before, after) of every level."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            run = at[k] // arity * arity
            path.append((nodes[run : at[k]], nodes[at[k] + 1 : run + arity]))
            at[k] //= arity
        nodes = [H(*nodes[k : k + arity]) for k in range(0, len(nodes), arity)]
    return nodes[0], paths


def by_hand(rows, arity):
    groups, out = defaultdict(list), []
    for r in rows:
        doc, source, lang, n, text = r[:5]
        leaf = H(*map(shown, (doc, source, lang, n, text)))
        hit = doc is not None and n is not None and zlib.crc32(str(doc).encode()) % 7 == 0
        groups[lang].append(((doc is not None, doc or 0, leaf), H(*map(shown, (doc, source, lang, n + 1, text))) if hit else leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    found = {g: (sorted(groups[g]), *tree([x[0][2] for x in sorted(groups[g])], arity)) for g in names}
    root, high = tree([found[g][1] for g in names], arity) if names else (None, [])
    for g, top in zip(names, high):
        leaves, subroot, paths = found[g]
        for ((has, doc, leaf), claimed), path in zip(leaves, paths):
            fold, proof = claimed, ""
            for before, after in path + top:
                fold, proof = H(*before, fold, *after), proof + "".join(before + after)
            out.append((doc if has else None, leaf, subroot, root, H(proof), fold, fold == root))
    return sorted(out, key=repr)


def check(spark, rows, arity=2):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, hash string, pos int, g int, path string, leaf string").repartition(3)
    got = merkle.checked_manifest(df, merkle.tampered_leaf(df), arity=arity)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(rows, arity)


ODD = [None, "", "a", "é漢🙂 ", "x" * 50_000, "1:a", "-"]


def test_trees_by_hand(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, a group of several tiers, clashing names."""
    r = random.Random(1)
    langs = ["en"] * 6 + [None, "", "fr", "漢", "Z", "é"]
    rows = [(r.choice([None, k, k, k, k // 2]), r.choice([None, "web", ""]), r.choice(langs), r.choice([None, k, 2**63 - 1]), r.choice(ODD), "h", 1, 2, "p", "l") for k in range(330)]
    check(spark, rows + rows[:9])


@pytest.mark.parametrize("sizes", [[1], [2, 1], [64], [65, 3], [129]])
def test_runs_that_end_odd(spark, sizes):
    check(spark, [(100 * g + k, None, f"l{g}", 1, "t", "", 0, 0, "", "") for g, n in enumerate(sizes) for k in range(n)])


def test_other_arity(spark):
    check(spark, [(k, "s", "ab"[k % 7 == 0], k, "t", "", 0, 0, "", "") for k in range(50)], arity=3)


def test_many_groups(spark):
    check(spark, [(k, None, f"l{k}", None, None, "", 0, 0, "", "") for k in range(70)])


def test_empty_table(spark):
    check(spark, [])
