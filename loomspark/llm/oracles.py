"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SUFFIXES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
m AS (SELECT md5(s) AS k, min(doc_id) AS first FROM w GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM w JOIN m ON md5(w.s) = m.k WHERE first < doc_id)),
runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE start) AS n_spans, list(p) AS ps FROM
  (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <> 1, true) AS start FROM gone) GROUP BY doc_id),
kept AS (SELECT b.doc_id, string_agg(b.x, '' ORDER BY b.p) AS h FROM
  (SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM runs))) b
  ANTI JOIN gone g ON g.doc_id = b.doc_id AND g.p = b.p GROUP BY b.doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN runs.doc_id IS NULL THEN d.h ELSE coalesce(kept.h, '') END)) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_WINDOWS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM w JOIN m USING (s) WHERE first < doc_id)),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY 1),
kept AS (SELECT k.doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM d) k
  ANTI JOIN gone g ON g.doc_id = k.doc_id AND g.p = k.p GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_BENCHMARK = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS s FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
w AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(ws) >= n)),
hit AS (SELECT doc_id, i, w.n, item_id FROM w JOIN p ON w.n = p.n AND w.s = p.s),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM hit) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_EXACT = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size, row_number() OVER (g ORDER BY doc_id DESC) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""



def _merkle(levels: int = 24, group_levels: int = 8) -> str:
    """Trees of up to 2 ** levels leaves a language, and 2 ** group_levels languages: a step for each level."""
    shown = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END"
    leaf = lambda n: "sha256(" + " || ".join(shown(x) for x in ("doc_id", "source", "lang", n, "text")) + ")"
    # crc32 of the id's digits: bytes, each followed by eight marks for a shift by one bit.
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"

    def tree(name: str, leaves: str, depth: int) -> list[str]:
        """CTEs name0, name1, ...: (g, pos, n, h) of each level, a finished tree's root going on alone."""
        out = [f"{name}0 AS MATERIALIZED ({leaves})"]
        for k in range(depth):
            out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT g, pos // 2 AS pos, max((n + 1) // 2) AS n, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE max(h) END AS h FROM {name}{k} GROUP BY g, pos // 2)")
        return out

    def climb(start: str, name: str, node: str, depth: int, first: str) -> list[str]:
        """CTEs that walk up from each row's node: proof so far and folded digest so far."""
        out, last = [], first
        for k in range(depth):
            sib, at = f"coalesce(s.h, '')", f"(r.{node} >> {k})"
            fold = f"CASE WHEN o.n = 1 THEN r.fold WHEN {at} % 2 = 1 THEN sha256({sib} || r.fold) ELSE sha256(r.fold || {sib}) END"
            out.append(f"{start}{k} AS (SELECT r.* REPLACE (r.proof || {sib} AS proof, {fold} AS fold) FROM {last} r JOIN {name}{k} o ON o.g = r.{'g' if name == 't' else 'top'} AND o.pos = {at} LEFT JOIN {name}{k} s ON s.g = o.g AND s.pos = xor({at}, 1))")
            last = f"{start}{k}"
        return out

    rows = f"rows_ AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf('n_chars')} AS leaf, CASE WHEN {crc} % 7 = 0 THEN {leaf('(n_chars + 1)')} ELSE {leaf('n_chars')} END AS fold FROM documents)"
    placed = "placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM rows_)"
    steps = [rows, placed, *tree("t", "SELECT g, pos, n, leaf AS h FROM placed", levels)]
    steps.append(f"roots AS MATERIALIZED (SELECT g AS lang_g, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS place, count(*) OVER () AS many FROM t{levels})")
    steps += tree("u", "SELECT '' AS g, place AS pos, many AS n, subroot AS h FROM roots", group_levels)
    steps.append(f"begun AS (SELECT p.doc_id, p.g, '' AS top, p.pos, r.place, p.leaf, r.subroot, (SELECT h FROM u{group_levels}) AS root, '' AS proof, p.fold FROM placed p JOIN roots r ON r.lang_g = p.g)")
    steps += climb("c", "t", "pos", levels, "begun") + climb("e", "u", "place", group_levels, f"c{levels - 1}")
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM e{group_levels - 1}"


_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""


_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, max(page_id) OVER g AS top, row_number() OVER (g ORDER BY page_id DESC) = 1 AS first FROM pages WINDOW g AS (PARTITION BY coalesce(html, ''))),
h AS (SELECT *, sha1(t) AS x FROM p)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(x, 1 + 5 * (k // 4), 5) AS INTEGER) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT first THEN top END AS refers_to
FROM h
"""


SQL = {"op13_warc": _WARC, "op12_hard_negatives": _NEGATIVES, "op11_merkle_manifest": _merkle(), "op5_suffix_array": _SUFFIXES, "op6_substring": _WINDOWS, "op8_decontaminate": _BENCHMARK, "op9_exact": _EXACT}
