"""Patches, edits and survival of lines. Parsing is relational; only true sequence matching needs Python."""

from __future__ import annotations

import difflib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import meaningful_lines, multiset_recall, squeezed


def unified_patch(df: DataFrame, keys: list[str], patch: str) -> DataFrame:
    """keys, path, added, deleted (arrays of squeezed, non-empty lines, in order) of each file of unified diffs.

    The path is the new one, or the old one of a deleted file. A line's file is the last header above it.
    """
    lines = df.select(*keys, F.posexplode(F.split(patch, "\n")).alias("no", "line"))
    old = F.regexp_extract("line", r"^--- (?:a/)?(\S+)", 1)
    new = F.regexp_extract("line", r"^\+\+\+ (?:b/)?(\S+)", 1)
    w = W.partitionBy(*keys).orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    marked = lines.withColumns({"old": F.last(F.when(old != "", old), ignorenulls=True).over(w), "new": F.last(F.when(new != "", new), ignorenulls=True).over(w)})
    body = marked.where(~F.col("line").rlike(r"^(\+\+\+|---) ") & F.col("line").rlike(r"^[+-]")).withColumn("path", F.when(F.col("new") == "/dev/null", F.col("old")).otherwise(F.col("new"))).where("path is not null")
    text = squeezed(F.expr("substr(line, 2)"))
    side = lambda mark: F.transform(F.array_sort(F.collect_list(F.when(F.startswith("line", F.lit(mark)) & (text != ""), F.struct("no", text.alias("t"))))), lambda s: s["t"])
    return body.groupBy(*keys, "path").agg(side("+").alias("added"), side("-").alias("deleted"))


def numstat(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, path, added, deleted, binary from lines of three fields parted by tabs, blanks or commas; `-` is binary."""
    line = df.select(*keys, F.explode(F.split(text, r"\r?\n")).alias("line")).where(F.trim("line") != "")
    parts = F.split(F.trim("line"), r"\t|,|\s+", 3)
    rows = line.withColumn("p", parts).where(F.size("p") == 3).where(F.col("p")[0].rlike("^([0-9]+|-)$"))
    number = lambda k: F.expr(f"try_cast(p[{k}] as bigint)")
    return rows.select(*keys, F.col("p")[2].alias("path"), F.coalesce(number(0), F.lit(0)).alias("added"), F.coalesce(number(1), F.lit(0)).alias("deleted"), (F.col("p")[0] == "-").alias("binary"))


def name_status(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, status, path from lines such as `M<tab>path`; a rename has its new path."""
    line = df.select(*keys, F.explode(F.split(text, r"\r?\n")).alias("line")).where(F.trim("line") != "")
    p = F.split("line", r"\t")
    return line.where(F.size(p) >= 2).select(*keys, F.left(p[0], F.lit(1)).alias("status"), F.element_at(p, -1).alias("path"))


def patch_actions(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, kind, path, added, deleted of each file of a `*** Begin Patch` text."""
    lines = df.select(*keys, F.posexplode(F.split(text, "\n")).alias("no", "line"))
    head = F.regexp_extract("line", r"^\*\*\* (Add|Update|Delete) File: (.+)$", 2)
    kind = F.regexp_extract("line", r"^\*\*\* (Add|Update|Delete) File: (.+)$", 1)
    w = W.partitionBy(*keys).orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    inside = lines.withColumns({"path": F.last(F.when(head != "", F.trim(head)), ignorenulls=True).over(w), "kind": F.last(F.when(kind != "", F.lower(kind)), ignorenulls=True).over(w)}).where("path is not null")
    said = squeezed(F.expr("substr(line, 2)"))
    side = lambda mark: F.transform(F.array_sort(F.collect_list(F.when(F.startswith("line", F.lit(mark)) & (said != ""), F.struct("no", said.alias("t"))))), lambda s: s["t"])
    return inside.groupBy(*keys, "kind", "path").agg(side("+").alias("added"), side("-").alias("deleted"))


class Replay:
    """A file as its edits make it. The first `seed` gives the content; an edit whose old text is empty, or is not there,
    counts as a miss and changes nothing; nulls are empty texts."""

    def __init__(self, content: str = "", misses: int = 0, seeded: bool = False):
        self.content, self.misses, self.seeded = content, misses, seeded

    def step(self, kind: str | None, old: str | None, new: str | None) -> None:
        if kind == "seed" and not self.seeded:
            self.content, self.seeded = new or "", True
        elif kind == "edit":
            at = self.content.find(old) if self.seeded and old else -1
            if at < 0:
                self.misses += 1
            else:
                self.content = f"{self.content[:at]}{new or ''}{self.content[at + len(old) :]}"


def replay(df: DataFrame, keys: list[str], order: str, kind: str, old: str, new: str) -> DataFrame:
    """keys, content, misses: each key's file after its edits in order.

    Edits are sorted by key and order and pass a worker in batches, which carries the file at hand from one to the next: a
    key's edits are never one array, and any number of them needs no more memory than its file.
    """
    spark = df.sparkSession
    rows = df.select(*keys, F.col(order).alias("__o"), F.col(kind).alias("__k"), F.col(old).alias("__a"), F.col(new).alias("__b"))
    ordered = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "__o").drop("__o")
    schema = T.StructType([*[T.StructField(k, df.schema[k].dataType) for k in keys], T.StructField("content", T.StringType()), T.StructField("misses", T.LongType())])

    def run(batches):
        at, file, done, size = None, None, [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*keys, "__k", "__a", "__b")]
            for row in zip(*columns, strict=True):
                key, (what, a, b) = row[: len(keys)], row[len(keys) :]
                if key != at:
                    if file:
                        done.append((*at, file.content, file.misses))
                        size += len(file.content) + 100
                    at, file = key, Replay()
                file.step(what, a, b)
            if size > 1 << 20:
                yield made(done)
                done, size = [], 0
        if file:
            yield made([*done, (*at, file.content, file.misses)])

    def made(done):
        return pa.RecordBatch.from_arrays([pa.array(c, type=to_arrow_type(f.dataType)) for c, f in zip(zip(*done, strict=True), schema, strict=True)], names=schema.names)

    return ordered.mapInArrow(run, schema)


def replay_stream(edits: DataFrame, keys: list[str], order: str, kind: str, old: str, new: str) -> DataFrame:
    """What replay gives, of a stream of edits, in update mode: keys, content, misses, late of each key that a trigger
    brings edits of. A key's file, misses and last order are its state; an edit whose order is not above the last one that
    an earlier trigger brought is late: it is counted and left out. Triggers sort their own edits."""
    rows = edits.select(*keys, F.col(order).cast("long").alias("o"), F.col(kind).alias("k"), F.col(old).alias("a"), F.col(new).alias("b"))
    schema = T.StructType([*[T.StructField(k, edits.schema[k].dataType) for k in keys], T.StructField("content", T.StringType()), T.StructField("misses", T.LongType()), T.StructField("late", T.LongType())])

    def run(key, batches, state):
        content, misses, seeded, last, late = state.get if state.exists else ("", 0, False, None, 0)
        frames = [x for x in batches]
        every = pd.concat(frames).sort_values("o", kind="stable") if frames else pd.DataFrame(columns=["o", "k", "a", "b"])
        file, top = Replay(content, misses, seeded), last
        for o, what, a, b in zip(every["o"], every["k"], every["a"], every["b"], strict=True):
            if last is not None and o <= last:
                late += 1
                continue
            file.step(what, a, b)
            top = int(o) if top is None else max(top, int(o))
        state.update((file.content, file.misses, file.seeded, top, late))
        yield pd.DataFrame([(*key, file.content, file.misses, late)], columns=schema.names)

    return rows.groupBy(*keys).applyInPandasWithState(run, schema, "content string, misses long, seeded boolean, last long, late long", "update", "NoTimeout")


def patch_sections(text: Column) -> Column:
    """The files of a `*** Begin Patch` text, in order: an array of (operation, path, added, deleted), lines squeezed and
    non-empty. A file may come more than once."""
    head = r"^\*\*\* (Add|Update|Delete) File: (.+)$"
    parts = F.filter(F.split(F.regexp_replace(text, "\r\n?", "\n"), r"(?m)^(?=\*\*\* (?:Add|Update|Delete) File: .)"), lambda x: x.rlike("^" + head.replace("^", "").replace("$", "")))

    def section(x: Column) -> Column:
        lines = F.split(x, "\n")
        said = lambda mark: F.filter(F.transform(F.filter(lines, lambda y: F.startswith(y, F.lit(mark))), lambda y: squeezed(F.substring(y, 2, 1 << 30))), lambda y: y != "")
        first = F.element_at(lines, 1)
        return F.struct(F.lower(F.regexp_extract(first, head, 1)).alias("operation"), F.trim(F.regexp_extract(first, head, 2)).alias("path"), said("+").alias("added"), said("-").alias("deleted"))

    return F.coalesce(F.transform(parts, section), F.array().cast("array<struct<operation: string, path: string, added: array<string>, deleted: array<string>>>"))


def _changes(a: list[str], b: list[str]) -> list:
    return [o for o in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if o[0] != "equal"]


def line_delta(old: str, new: str) -> tuple[list[str], list[str]]:
    a, b = ([" ".join(x.split()) for x in t.splitlines() if x.strip()] for t in (old, new))
    ops = _changes(a, b)
    return [x for o in ops for x in b[o[3] : o[4]]], [x for o in ops for x in a[o[1] : o[2]]]


@F.pandas_udf(T.StructType([T.StructField("added", T.ArrayType(T.StringType())), T.StructField("deleted", T.ArrayType(T.StringType()))]))
def edit_delta(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    """Lines that only the new, and only the old text has at a place, by longest matching blocks of the squeezed,
    non-empty lines; null counts as empty."""
    return pd.DataFrame([line_delta(a, b) for a, b in zip(old.fillna(""), new.fillna(""), strict=True)], columns=["added", "deleted"])


@F.pandas_udf(T.LongType())
def changed_lines(old: pd.Series, new: pd.Series) -> pd.Series:
    """Added and deleted lines of a diff without context, of the lines as they are; null counts as empty."""
    return pd.Series([sum(o[2] - o[1] + o[4] - o[3] for o in _changes(a.splitlines(), b.splitlines())) for a, b in zip(old.fillna(""), new.fillna(""), strict=True)], dtype="int64")


#: Likeness from which a line counts as found.
ALIKE = 0.8


class Pool:
    """Haystack lines of which each is taken once: finds, for a needle line, the free line of greatest likeness (ties: the
    first), with as few true ratios as exact bounds allow.

    An equal line has likeness 1. Otherwise twice the common characters, counted with repeats, over the lengths is never
    less than the ratio: lines are tried by that bound, largest first, until the best ratio so far is above all bounds left.
    """

    def __init__(self, lines: list[str]):
        self.lines = list(dict.fromkeys(lines))
        place = {x: k for k, x in enumerate(self.lines)}
        self.free: list[list[int]] = [[] for _ in self.lines]  # places of equal lines, the last one first
        for k in range(len(lines) - 1, -1, -1):
            self.free[place[lines[k]]].append(k)
        self.place, self.left, self.ratios = place, len(lines), 0
        self.letters = {c: k for k, c in enumerate(sorted(set().union(*self.lines)))}
        self.size = np.array([len(x) for x in self.lines], dtype=np.int64)
        self.counts = np.zeros((len(self.letters), len(self.lines)), dtype=np.int32)
        for k, x in enumerate(self.lines):
            for c, n in Counter(x).items():
                self.counts[self.letters[c], k] = n
        self.alive = np.ones(len(self.lines), dtype=bool)
        self.matchers: list[difflib.SequenceMatcher | None] = [None] * len(self.lines)

    def _take(self, k: int) -> None:
        self.free[k].pop()
        self.left -= 1
        self.alive[k] = bool(self.free[k])

    def take(self, line: str) -> float:
        """Likeness of the line taken."""
        same = self.place.get(line)
        if same is not None and self.free[same]:
            self._take(same)
            return 1.0
        common = np.zeros(len(self.lines), dtype=np.int64)
        for c, n in Counter(line).items():
            if c in self.letters:
                common += np.minimum(self.counts[self.letters[c]], n)
        live = np.flatnonzero(self.alive)
        whole = self.size[live] + len(line)
        bound = np.where(whole > 0, 2.0 * common[live] / np.maximum(whole, 1), 1.0)
        first = np.array([self.free[k][-1] for k in live.tolist()])
        best, at = -1.0, -1
        for k in np.lexsort((first, -bound)).tolist():
            if bound[k] < best or bound[k] == best and first[k] > self.free[at][-1]:
                if bound[k] < best:
                    break
                continue
            j = int(live[k])
            if bound[k] > 0:
                if self.matchers[j] is None:
                    self.matchers[j] = difflib.SequenceMatcher(None, "", self.lines[j], autojunk=False)
                self.matchers[j].set_seq1(line)
                ratio = self.matchers[j].ratio()
                self.ratios += 1
            else:
                ratio = 0.0
            if ratio > best or ratio == best and self.free[j][-1] < self.free[at][-1]:
                best, at = ratio, j
        self._take(at)
        return best


@F.pandas_udf(T.DoubleType())
def fuzzy_recall(needle: pd.Series, haystack: pd.Series) -> pd.Series:
    """Mean, over the needle's lines, of the likeness to the best haystack line that no earlier one has taken (ties: the
    first); likenesses below ALIKE count as 0 but take their line. 1 for an empty needle."""
    out = []
    for a, b in zip(needle, haystack, strict=True):
        a, total = list(a if a is not None else []), 0.0
        pool = Pool(list(b if b is not None else []))
        for x in a:
            if not pool.left:
                break
            likeness = pool.take(x)
            total += likeness if likeness >= ALIKE else 0.0
        out.append(total / len(a) if a else 1.0)
    return pd.Series(out, dtype="float64")


def text_recall(needle: Column, haystack: Column) -> Column:
    """The larger of the exact recall with repeats and the fuzzy one."""
    return F.greatest(multiset_recall(needle, haystack), fuzzy_recall(needle, haystack))


def edge_confidence(path_found: Column, recall: Column, has_text: Column) -> Column:
    """The ladder of an edit's link to a commit; an edit without text is held strong when its path is found."""
    return F.when(~path_found, None).when(~has_text, "strong").when(recall >= 0.999, "exact").when(recall >= 0.7, "strong").when(recall >= 0.3, "moderate").otherwise("weak")


def line_survival(lines: Column, committed: Column) -> Column:
    """Share of the lines that the committed text has; null without lines."""
    there = meaningful_lines(committed)
    return F.try_divide(F.size(F.filter(lines, lambda x: F.array_contains(there, x))).cast("double"), F.size(lines).cast("double"))
