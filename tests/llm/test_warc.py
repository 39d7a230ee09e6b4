"""WARC archives: round trips, revisits, and salvage of files damaged at known places."""

import base64
import gzip
import hashlib
import random

import pytest

from loomspark.llm import warc

SCHEMA = "page_id long, url string, html string, uid int, key string, member int, top_id int"
ODD = [None, "", "a", "é漢🙂\r\n\r\nWARC/1.1\r\n", "<html>" + "x" * 40_000, "\x00\x1f\x8b\x08"]


def sha1(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "k", 2, 3) for r in rows], SCHEMA).repartition(parts)


def by_hand(rows, least=0):
    out, groups = [], {}
    for k, (page, _, html) in enumerate(rows):
        groups.setdefault((html or "").encode(), []).append((page is not None, page or 0, k))
    for k, (page, _, html) in enumerate(rows):
        b = (html or "").encode()
        top = max((has, p) for has, p, _ in groups[b])
        first = next(j for has, p, j in groups[b] if (has, p) == top) == k
        response = first or len(b) < least
        out.append((page, len(b), sha1(b), "response" if response else "revisit", None if response or not top[0] else top[1]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 2, 100])
@pytest.mark.parametrize("file_bytes", [8 << 20, 3000])
def test_archives_by_hand(spark, monkeypatch, least, file_bytes):
    monkeypatch.setattr(warc, "FILE_BYTES", file_bytes)
    r = random.Random(2)
    rows = [(r.choice([None, k, k, k // 2]), r.choice([None, "", f"http://é.x/{k} y\r\nz"]), r.choice(ODD + [f"page {k}"])) for k in range(120)]
    got = warc.archived(frame(spark, rows), min_bytes=least)
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(rows, least)


def test_empty_tables(spark):
    assert warc.archived(frame(spark, [])).count() == 0


def test_files_are_gzip_of_whole_records(spark, tmp_path):
    where = str(tmp_path / "w")
    rows = [(k, f"http://x/{k}", f"<p>{k % 5} é</p>") for k in range(40)]
    warc.write_warc(frame(spark, rows), where)
    files = [f for f in (tmp_path / "w").iterdir() if f.name.startswith("part-") and f.stat().st_size]
    text = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert text.count(b"WARC-Type: response") == 5 and text.count(b"WARC-Type: revisit") == 35 and text.count(b"WARC-Type: warcinfo") == len(files)
    found = warc.read_warc(spark, where).where("type = 'response'").collect()
    assert {bytes(x.payload).decode() for x in found} == {f"<p>{k} é</p>" for k in range(5)} and {x.uri for x in found} <= {u for _, u, _ in rows}
    assert warc.read_warc(spark, where).where("kind = 'gap'").count() == 0


def test_very_long_records_end_files_with_a_zero(spark):
    text = "".join(random.Random(1).choices("abcdefgh", k=1 << 16)) * 300  # 19 MB
    got = warc.archived(spark.createDataFrame([(1, "u", text), (2, "u", "b")], "page_id long, url string, html string").repartition(1))
    assert sorted((r.page_id, r.payload_bytes) for r in got.collect()) == [(1, len(text)), (2, 1)]


def some_records(n, seed=0):
    r = random.Random(seed)
    out = []
    for k in range(n):
        body = r.choice([b"", b"text %d " % k * r.randint(1, 900), r.randbytes(r.randint(1, 3000)), b"WARC/1.1\r\nWARC-Type: x\r\n\r\n", b"\x1f\x8b\x08" + r.randbytes(9)])
        out.append(warc._page_record(k, k, f"http://x/{k}", "2020-01-01T00:00:00Z", sha1(body), len(body), body, None))
    return out


def ids(entries):
    return [int(e[3]["record_id"].split(":")[2]) for e in entries if e[3]]


def places(parts):
    at, out = 0, []
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


@pytest.mark.parametrize("packed", [True, False])
def test_damage_costs_only_what_it_touches(packed):
    for seed in range(60):
        r = random.Random(seed)
        parts = [warc.member(x) if packed else x for x in some_records(12, seed)]
        where = places(parts)
        hurt = sorted(r.sample(range(12), r.randint(1, 4)))
        whole = bytearray(b"".join(parts))
        for k in hurt:
            for _ in range(r.choice([1, 30])):
                # Headers of uncompressed records have no checksum of their own; the rest has.
                at = r.randrange(where[k][0] + (0 if packed else parts[k].index(b"\r\n\r\n") + 4), where[k][1])
                whole[at] ^= r.randrange(1, 256)
        got = list(warc.salvage(bytes(whole)))
        assert set(range(12)) - set(hurt) <= set(ids(got)), seed
        spans = sorted({e[:2] for e in got if e[0] < e[1]})
        assert spans[0][0] == 0 and spans[-1][1] == len(whole) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        for k in set(hurt) - set(ids(got)):  # what is lost lies in a logged gap
            assert any(e[4] and e[0] <= where[k][0] and e[1] >= where[k][1] for e in got), seed


def test_reasons_and_gaps():
    parts = [warc.member(x) for x in some_records(5)]
    (a, b), (c, d) = places(parts)[2], places(parts)[3]
    whole = b"".join(parts)
    cases = {
        "no version line": (whole[:a] + b"junk" + whole[a:], (a, a + 4), {0, 1, 2, 3, 4}),
        "gzip": (whole[: b - 6] + b"\xff" + whole[b - 5 :], (a, b), {0, 1, 3, 4}),
        "gzip: cut off": (whole[: (c + d) // 2], (c, (c + d) // 2), {0, 1, 2}),
    }
    for reason, (damaged, span, left) in cases.items():
        got = list(warc.salvage(damaged))
        gaps = [e for e in got if e[4]]
        assert [e[:2] for e in gaps] == [span] and gaps[0][4].startswith(reason) and set(ids(got)) == left
    plain = some_records(3)
    for reason, old, new in (("length beyond", b"Content-Length: ", b"Content-Length: 9999"), ("length", b"Content-Length: ", b"Content-Length: x"), ("block digest", b"HTTP/1.1 200", b"HTTP/1.1 201"), ("header lacks", b"WARC-Type", b"WARC-Tipe"), ("no version", b"WARC/1.1", b"WARC-1.1"), ("header line", b"WARC-Type: ", b"WARC-Type ")):
        at = plain[1].index(old)
        hurt = plain[1][:at] + new + plain[1][at + len(old) :]
        got = list(warc.salvage(plain[0] + hurt + plain[2]))
        gaps = [e for e in got if e[4]]
        assert len(gaps) == 1 and gaps[0][:2] == (len(plain[0]), len(plain[0]) + len(hurt)) and gaps[0][4].startswith(reason) and ids(got) == [0, 2], reason


def test_other_layouts():
    plain = some_records(6, 3)
    one = gzip.compress(b"".join(plain))
    assert ids(warc.salvage(one)) == [0, 1, 2, 3, 4, 5]
    assert ids(warc.salvage(warc.member(plain[0]) + plain[1] + b"".join(map(warc.member, plain[2:])))) == [0, 1, 2, 3, 4, 5]
    hurt = bytearray(b"".join(plain))
    hurt[len(plain[0]) + 300] ^= 1
    got = list(warc.salvage(gzip.compress(bytes(hurt))))
    assert ids(got) == [0, 2, 3, 4, 5] and [e[2] for e in got if e[4]] == [len(plain[0])]
    big = some_records(60, 5)
    cut = list(warc.salvage(gzip.compress(b"".join(big))[:-2000] + warc.member(plain[5])))
    assert ids(cut)[-1] == 5 and len(ids(cut)) > 30 and ids(cut)[:-1] == list(range(len(ids(cut)) - 1)) and sum(bool(e[4]) for e in cut) == 1
    assert list(warc.salvage(b"")) == [] and [e[4] for e in warc.salvage(b"x" * 50)] == ["no version line"]


def test_gaps_are_logged_beside_records(spark, tmp_path):
    parts = [warc.member(x) for x in some_records(6, 9)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts[:3]) + b"??" + b"".join(parts[3:]))
    (tmp_path / "b.warc").write_bytes(b"")
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert [(r.end - r.start, r.reason is not None) for r in got if r.kind == "gap"] == [(2, True)]
    assert sorted(int(r.record_id.split(":")[2]) for r in got if r.kind == "record") == list(range(6))
