"""Whole queries against models written out one row, one word or one tree at a time, and cases of memory and formats."""

import json
import math
import os
import random
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest

from loomspark.llm import common as C
from loomspark.llm import decontaminate, exact, lm, quality, tokenfile

TEXTS = ["", None, "The CAT sat.", "the the\tthe", "aé b", "cat\nsat on a mat", "on on on", "Ünï x", "a b c d", "end"]


def frame(spark, texts=TEXTS, parts=3):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)


def test_scores_of_all_segmentations_by_hand(spark):
    """Two rounds of expected counts from every way to cut every word, then the probability of each text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=C.vocabulary_path("piece_bpe_32k.model"))
    pieces, prior, single = {}, {"end": 1e-2}, {}
    for k in range(model.get_piece_size()):
        text = model.id_to_piece(k)
        if model.is_byte(k):
            single[int(text[3:-1], 16)] = k
            prior[k] = 1e-7
        elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)) and "▁" not in text[1:]:
            pieces[text.encode()] = k
            prior[k] = 1 / (1 + 2.7 - model.get_score(k))
    total = sum(prior.values())
    prior = {k: v / total for k, v in prior.items()}
    mark = "▁".encode()

    @cache
    def cuts(word, start=0):
        if start == len(word):
            return [()]
        out = [(single[word[start]], *rest) for rest in cuts(word, start + 1)]
        for end in range(start + 1, len(word) + 1):
            k = pieces.get(word[start:end])
            if k is not None and (start == 0 or not word[start:end].startswith(mark)):
                out += [(k, *rest) for rest in cuts(word, end)]
        return out

    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
    words = {k: [mark + w.encode() for w in lower(t)] for k, t in enumerate(TEXTS)}
    train = [k for k in words if zlib.crc32(str(k).encode()) % 7 != 2]
    counts = Counter(w for k in train for w in words[k])
    p = prior
    for _ in range(2):
        new = {k: 1000 * v for k, v in prior.items()}
        new["end"] += len(train)
        for w, n in counts.items():
            each = [(math.prod(p[k] for k in cut), cut) for cut in cuts(w)]
            whole = sum(x for x, _ in each)
            for x, cut in each:
                for k in cut:
                    new[k] += n * x / whole
        whole = sum(new.values())
        p = {k: v / whole for k, v in new.items()}
    got = {r.doc_id: r.score for r in lm.score_documents(frame(spark)).collect()}
    for k, own in words.items():
        want = math.log10(p["end"]) + sum(math.log10(sum(math.prod(p[x] for x in cut) for cut in cuts(w))) for w in own)
        assert got[k] == pytest.approx(want, rel=1e-9), TEXTS[k]


def test_words_are_numbered_in_bounded_pieces(spark, monkeypatch):
    whole = sorted(map(tuple, lm.score_documents(frame(spark)).collect()))
    monkeypatch.setattr(lm, "GATHERED", 1)
    assert [tuple(pytest.approx(x) if isinstance(x, float) else x for x in r) for r in sorted(map(tuple, lm.score_documents(frame(spark)).collect()))] == whole


def plain_statistics(text):
    """The statistics of a text, counted one character, word and line at a time."""
    n = len(text)
    if not n:
        return [0.0] * 28
    share = lambda test: sum(map(test, text)) / n
    kinds = [share(lambda b: 65 <= b <= 90), share(lambda b: 97 <= b <= 122), share(lambda b: 48 <= b <= 57), share(lambda b: b in b".,;:?'\"-()"), share(lambda b: b == 33), share(lambda b: b in b"#$%&*+=<>@^_`~\\/"), share(lambda b: b in b"|[]{}"), share(lambda b: b in b" \t"), share(lambda b: b in b"\n\r"), share(lambda b: b >= 128)]
    times = Counter(text)
    entropy = -sum(c / n * math.log2(c / n) for c in times.values())
    words = text.split()
    m, sizes = len(words) or 1, [len(w) for w in words] or [0]
    mean = sum(sizes) / len(sizes)
    lines = text.split(b"\n")
    filled = [x for x in lines if x.strip()]
    f = len(filled) or 1
    marks = max(c for b, c in [*times.items(), (33, 0)] if 33 <= b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 127)
    return [
        math.log(1 + n), math.log(1 + len(words)), *kinds, entropy, marks / n, mean, math.sqrt(sum((x - mean) ** 2 for x in sizes) / len(sizes)), max(sizes), len(set(words)) / m,
        sum(w.isupper() for w in words) / m, sum(w.istitle() for w in words) / m, len(filled), len(set(filled)) / f, n / f, (times[46] + times[33] + times[63]) / m,
        sum(x[-1:] in (b".", b"!", b"?", b":", b'"', b"'") for x in filled) / f, len(set(zip(words, words[1:]))) / max(1, len(words) - 1), len(set(zip(words, words[1:], words[2:]))) / max(1, len(words) - 2), times[10] / m,
    ]


def test_quality_by_hand(spark):
    """Every score is the walk of its statistics through the learned trees, labels of the held-out fold unseen."""
    r = random.Random(4)
    good = [" ".join(r.choice(["Rain", "falls", "on", "the", "roof."]) for _ in range(r.randint(5, 60))) for _ in range(90)]
    bad = ["".join(r.choice("#$% x1\n") for _ in range(r.randint(5, 90))) for _ in range(90)]
    texts = [*TEXTS, *good, *bad, "x" * 30_000]
    df = spark.createDataFrame([(k, t, k % 2, 1.0, "en") for k, t in enumerate(texts)], "doc_id long, text string, quality int, score double, lang string").repartition(3)
    labels = spark.createDataFrame([(k, int(10 <= k < 100)) for k in range(10, 190)] + [(10, 1), (None, 1), (11, None)], "doc_id long, quality int")
    forest = quality.fit(df, labels)
    other = labels.collect()
    flipped = spark.createDataFrame([(x.doc_id, (1 - x.quality) if x.doc_id is not None and x.quality is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1 else x.quality) for x in other], "doc_id long, quality int")
    for x in quality.quality_scores(df, flipped).collect():
        row = plain_statistics((texts[x.doc_id] or "").encode())
        total = forest.base
        for node in forest.roots.tolist():
            while forest.left[node] != node:
                node = int(forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] + 1e-9 * abs(forest.threshold[node]) else forest.right[node])
            total += forest.value[node]
        assert x.score == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-6) and x.predicted == (x.score >= 0.5) and x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1)


def test_statistics_by_hand():
    r = random.Random(5)
    for _ in range(300):
        text = "".join(r.choice("ab Z.\n\t#é!0?") for _ in range(r.randint(0, 60))).encode()
        assert quality.statistics(text) == pytest.approx(plain_statistics(text))


def test_rows_that_repeat_an_id_are_learned_from_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "boost", lambda x, y: seen.append(len(y)) or quality.Forest(0.0, [], [], [], [], [], [], 0))
    df = spark.createDataFrame([(k % 3 + 2, f"text {k}") for k in range(90)], "doc_id long, text string")
    quality.fit(df, spark.createDataFrame([(2, 1), (3, 0), (4, 1)], "doc_id long, quality int"))
    assert seen == [sum(zlib.crc32(str(k).encode()) % 3 != 1 for k in (2, 3, 4))]


def test_one_index_for_a_task(spark, monkeypatch):
    """Rows of one text leave a task once though they come in many batches, and a hit is verified against the text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.createDataFrame([(k, f"t{k % 4}") for k in range(400)], "doc_id long, text string").coalesce(1)
        assert df.mapInArrow(exact._local, exact.LOCAL).count() == 4
        assert {(r.keep_id, r.group_size) for r in exact.exact_dedup(df).collect()} == {(k, 100) for k in (396, 397, 398, 399)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(90)), "text": [f"text {k % 30}" for k in range(90)]})
    monkeypatch.setattr(exact, "MOST_ROWS", 10)
    rows = [r for out in exact._local([batch.slice(k, 5) for k in range(0, 90, 5)]) for r in out.to_pylist()]
    assert sum(r["n"] for r in rows) == 90 and {r["digest"] for r in rows} == {r["digest"] for out in exact._local([batch]) for r in out.to_pylist()}

    class Same:
        def __init__(self, text):
            pass

        def digest(self):
            return b"\0" * 32

    monkeypatch.setattr(exact.hashlib, "sha256", Same)
    with pytest.raises(ValueError, match="two texts"):
        list(exact._local([pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["one", "two"]})]))


def test_blocks_of_the_benchmark_change_nothing(spark, monkeypatch):
    docs = frame(spark, ["a b c d e f g h i j k l", "short one here", "nothing", None, "x y a b c d e f g h i j"])
    bench = spark.createDataFrame([(3, "a b c d e f g h i j"), (1, "One here"), (10, "b c d e f g h i j k"), (2, "one HERE"), (7, "")], "item_id long, text string")
    cells = lambda: sorted(map(tuple, decontaminate.decontaminate(docs, bench).select("doc_id", "n_hit", "n_items", "items_sha256").collect()))
    whole = cells()
    assert [(r[0], r[1], r[2]) for r in whole] == [(0, 11, 2), (1, 2, 2), (2, 0, 0), (3, 0, 0), (4, 10, 1)]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 10)
    assert len(list(decontaminate.benchmark_blocks(bench, 10, 20_000))) > 1 and cells() == whole
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == [2, 3]


def test_other_tokenizer_formats_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="white space"):
        tokenfile.write_tokens(frame(spark), f"file://{tmp_path}/x", "byte_bpe_50k.json")
    with open(C.vocabulary_path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    assert tokenfile.fits(spec)
    for part, value in (("normalizer", None), ("pre_tokenizer", {"type": "ByteLevel"}), ("model", {"type": "WordLevel"})):
        assert not tokenfile.fits({**spec, part: value})


def test_files_of_few_ids(spark, monkeypatch, tmp_path):
    """Documents keep their places whatever the size of files; a long one makes a file of its own."""
    r = random.Random(9)
    texts = [" ".join(r.choice(["one", "two", "three!"]) for _ in range(r.choice([0, 1, 30]))) for _ in range(60)]
    whole = sorted(map(tuple, tokenfile.token_index(frame(spark, texts)).collect()))
    monkeypatch.setattr(tokenfile, "FILE_IDS", 16)
    assert [x[1] for x in whole] == np.cumsum([0, *[x[2] for x in whole]]).tolist()[:-1]
    where = f"file://{tmp_path}/t"
    tokenfile.write_tokens(frame(spark, texts), where)
    assert sorted(map(tuple, tokenfile._from_files(spark, where, False).collect())) == whole


def test_lm_gains_by_each_round(spark, monkeypatch):
    """Log likelihood a token of held-out documents: the vocabulary's weights alone, then after one and two rounds."""
    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("test tables are not here")
    fit, seen = lm.fit, []
    for rounds in (0, 1, 2):
        monkeypatch.setattr(lm, "fit", lambda counted, file, rounds=rounds: fit(counted, file, rounds))
        rows = [r for r in lm.score_documents(spark.read.parquet(path)).collect() if r.held_out]
        seen.append(sum(r.score for r in rows) / sum(r.n_tokens for r in rows))
    assert seen[0] < seen[1] < seen[2] and seen[1] - seen[0] > 0.3
