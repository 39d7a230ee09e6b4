"""Lint of memory notes: their layout read into rows, and checks across notes, ledger, index and recordings.

A memory is a set of files: a note for each topic, a ledger of observations, an index. A note has a section for each mode
(`## mode — phrase`), in it stances (`Stance: side (n=3, ...)`) with how to apply them and dated examples, and last what
conflicts. Every fault is a row: memory, file, rule, detail.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import squeezed, token_estimate
from ..sources.tables import stored

# Fixed values of the layout.
MODES = ("discuss", "plan", "build", "verify", "ship", "configure")
INDEX, LEDGER, CONTEXT = "MEMORY.md", "observations.md", "project-context.md"
OTHER_FILES = (INDEX, LEDGER, CONTEXT, "other.md")
TITLE, PROJECT = "# Memory", "Project"
MOST_MODES, MOST_EXAMPLES, MOST_TOKENS, MOST_QUOTED = 3, 3, 900, 25
HEAD = r"^## (\w+) — (.+)$"
STANCE = r"^Stance(?: \([^)\n]*\))?: "
SIDE = r"^Stance(?: \([^)\n]*\))?: (.+?) \(n=(\d+)"
EXAMPLE = '^\\s*-\\s*(\\d{4}-\\d{2}-\\d{2})\\b[^"“]*["“](.+)["”]'
GIST = r"^\s*-\s*\d{4}-\d{2}-\d{2} \(ledger gist\): \S"
LINE = r"^- \[(\w+) · ([^\]]+)\]\(([^)]+)\) — (.+)$"


@dataclass
class Topic:
    code: str
    name: str
    file: str
    phase: str
    sides: list[str]
    phrases: dict[str, str] = field(default_factory=dict)


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, v)]) if pairs else F.create_map().cast("map<string, string>")


def _fault(rows: DataFrame, rule: str, when: Column | None = None, detail: Column | None = None) -> tuple:
    """A check of rows (memory, file and what the check needs)."""
    return rows, rule, F.lit(True) if when is None else when, F.coalesce((F.lit("") if detail is None else detail).cast("string"), F.lit(""))


def _found(checks: list[tuple]) -> DataFrame:
    """The faults of all checks: those of the same rows are looked for in one pass."""
    tables: dict[int, list[tuple]] = {}
    for check in checks:
        tables.setdefault(id(check[0]), []).append(check)
    out = []
    for own in tables.values():
        each = F.array(*[F.when(when, F.struct(F.lit(rule).alias("rule"), detail.alias("detail"))) for _, rule, when, detail in own])
        out.append(own[0][0].select("memory", "file", F.explode(F.filter(each, lambda f: f.isNotNull())).alias("f")).select("memory", "file", "f.rule", "f.detail"))
    return functools.reduce(DataFrame.unionByName, out).distinct()


def _starts(line: str) -> Column:
    return F.startswith("line", F.lit(line))


def ledger_counts(files: DataFrame) -> DataFrame:
    """memory, code, mode, side, n, corrected: how often the ledger has each stance, and whether ever with a correction."""
    cells = F.transform(F.split("line", r"\|"), lambda x: F.trim(x))
    lines = files.where(F.col("file") == LEDGER).select("memory", F.explode(F.split("text", "\r?\n")).alias("line")).select("memory", cells.alias("c"))
    rows = lines.where((F.size("c") >= 6) & F.col("c")[0].rlike(r"^\d{4}-\d{2}-\d{2}$"))
    return rows.groupBy("memory", F.upper(F.col("c")[1]).alias("code"), F.lower(F.col("c")[2]).alias("mode"), F.lower(F.col("c")[3]).alias("side")).agg(F.count("*").alias("n"), F.bool_or(F.startswith(F.lower(F.element_at("c", -1)), F.lit("yes"))).alias("corrected"))


def note_lines(notes: DataFrame) -> DataFrame:
    """memory, file, session_date, no, line, section, mode, phrase, block, listed of each line of notes.

    section counts mode headings, block the stances within a section, 0 above the first; lines from a section's `Conflicts`
    on have no block; listed tells lines that stand below the block's `Examples:`.
    """
    lines = notes.select("memory", "file", "session_date", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    whole = W.partitionBy("memory", "file").orderBy("no")
    found = lambda k: F.nullif(F.regexp_extract("line", HEAD, k), F.lit(""))
    rows = lines.withColumns({"section": F.sum(found(1).isNotNull().cast("int")).over(whole), "mode": F.last(found(1), True).over(whole), "phrase": F.trim(F.last(found(2), True).over(whole))})
    inside = W.partitionBy("memory", "file", "section").orderBy("no")
    over = F.max(_starts("Conflicts").cast("int")).over(inside) == 1
    rows = rows.withColumn("block", F.when((F.col("section") > 0) & ~over, F.sum(F.col("line").rlike(STANCE).cast("int")).over(inside)).otherwise(0))
    below = W.partitionBy("memory", "file", "section", "block").orderBy("no").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("listed", F.coalesce(F.max(F.contains("line", F.lit("Examples:"))).over(below), F.lit(False)) & (F.col("block") > 0))


def not_recorded(quotes: DataFrame, recordings: DataFrame) -> DataFrame:
    """The quotes (memory, quote and other columns) of which some segment, parted at ellipses, is in no recording of the memory;
    white space is squeezed on both sides.

    A segment of four words or more has whole words inside: it meets only recordings with its second and third word in a row;
    shorter ones meet all recordings of their memory. Both are then verified.
    """
    quotes = stored(quotes)
    segments = quotes.select("memory", "quote").distinct().select("memory", "quote", F.explode(F.filter(F.transform(F.split("quote", r"…|\.\.\."), squeezed), lambda s: s != "")).alias("s"))
    words = F.split("s", " ")
    segments = segments.withColumn("gram", F.when(F.size(words) >= 4, F.concat_ws(" ", F.get(words, F.lit(1)), F.get(words, F.lit(2)))))
    texts = stored(recordings.select("memory", squeezed(F.col("text")).alias("body")).withColumn("rec", F.xxhash64("memory", "body")))
    w = F.split("body", " ")
    pairs = F.array_distinct(F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, 1 << 30), lambda a, b: F.concat_ws(" ", a, b)))
    needed = segments.where("gram is not null").select("memory", "gram").distinct()
    index = texts.select("memory", "rec", F.explode(pairs).alias("gram")).join(needed, ["memory", "gram"], "left_semi").distinct()
    near = segments.where("gram is not null").join(index, ["memory", "gram"]).join(texts, ["memory", "rec"])
    short = segments.where("gram is null").join(texts, "memory")
    hit = near.select("memory", "quote", "s", "body").unionByName(short.select("memory", "quote", "s", "body")).where(F.contains("body", F.col("s"))).select("memory", "quote", "s").distinct()
    lost = segments.join(hit, ["memory", "quote", "s"], "left_anti").select("memory", "quote").distinct()
    none = quotes.where(F.forall(F.split("quote", r"…|\.\.\."), lambda s: F.trim(s) == "")).select("memory", "quote").distinct()
    return quotes.join(lost.unionByName(none).distinct(), ["memory", "quote"], "left_semi")


def lint(files: DataFrame, recordings: DataFrame, topics: list[Topic], phases: list[str], intro: str, project_line: str) -> DataFrame:
    """memory, file, rule, detail of every fault.

    files: memory, session_date (yyyy-mm-dd), file, text; recordings: memory, text. topics, phases and modes are as few as
    the layout names; everything else is joined. A null text is an empty one.
    """
    files = stored(files.select("memory", "session_date", "file", F.coalesce("text", F.lit("")).alias("text")))  # each check reads it
    of_file = {t.file: t for t in topics}
    at = lambda pairs: F.element_at(_map(pairs), F.col("file"))
    out = [_fault(files, "file name is not one of the fixed set", ~F.col("file").isin(*of_file, *OTHER_FILES))]
    notes = files.where(F.col("file").isin(*of_file)) if of_file else files.where(F.lit(False))
    notes = notes.withColumns({"code": at({f: t.code for f, t in of_file.items()}), "name": at({f: t.name for f, t in of_file.items()}), "phase": at({f: t.phase for f, t in of_file.items()})})
    front = F.regexp_extract("text", r"(?s)^---\n(.*?)\n---\n", 1)
    said = F.regexp_extract(front, r"(?m)^\s*description\s*:\s*(.*?)\s*$", 1)
    tokens = token_estimate(F.col("text"))
    out += [
        _fault(notes, "description is not the topic's name", said != F.col("name")),
        *[_fault(notes, "layout line is missing", ~F.contains("text", line), line) for line in (F.concat(F.lit("Phase: "), "phase"), F.concat(F.lit("Dimension: "), "code", F.lit(" · "), "name"))],
        _fault(notes, "too many tokens", tokens > MOST_TOKENS, tokens),
    ]
    lines = stored(note_lines(notes.select("memory", "file", "session_date", "text")))
    heads = lines.where(F.col("line").rlike(HEAD)).select("memory", "file", "section", "mode", "phrase")
    place = F.coalesce(F.array_position(F.array(*map(F.lit, MODES)), F.col("mode")).cast("int"), F.lit(0))
    place = F.when(place == 0, 99).otherwise(place)
    before = F.lag(place).over(W.partitionBy("memory", "file").orderBy("section"))
    known = F.col("mode").isin(*MODES)
    phrases = _map({f"{f}\0{m}": p for f, t in of_file.items() for m, p in t.phrases.items()})
    right = F.element_at(phrases, F.concat_ws("\0", "file", "mode"))
    out += [
        _fault(notes.join(heads, ["memory", "file"], "left_anti"), "no mode section"),
        _fault(heads.withColumn("back", place < before).where("back").select("memory", "file").distinct(), "mode sections are not in order"),
        _fault(heads, "mode is unknown", ~known, F.col("mode")),
        _fault(heads, "heading is not the mode's phrase", known & ~F.coalesce(right == F.col("phrase"), F.lit(False)), F.col("mode")),
    ]
    rows = lines.where((F.col("block") > 0) & known)
    stances = rows.where(F.col("line").rlike(STANCE))
    side = F.lower(F.trim(F.regexp_extract("line", SIDE, 1)))
    stances = stances.withColumns({"side": F.nullif(side, F.lit("")), "code": at({f: t.code for f, t in of_file.items()})})
    named = stances.where("side is not null").select("memory", "file", "section", "block", "mode", "side", "code")
    sides = F.element_at(F.create_map(*[x for f, t in of_file.items() for x in (F.lit(f), F.array(*[F.lit(s.lower()) for s in t.sides]))]), F.col("file")) if of_file else F.array().cast("array<string>")
    counts = stored(ledger_counts(files))
    spot = ["memory", "code", "mode", "side"]
    kept = (F.coalesce("n", F.lit(0)) >= 2) | F.coalesce("corrected", F.lit(False))
    here = F.concat_ws("/", "mode", "side")
    blocks = ["memory", "file", "section", "block"]
    parts = rows.groupBy(*blocks).agg(F.bool_or(F.col("line").rlike(r"^How to apply: \S")).alias("applied"), F.count_if(F.col("listed") & F.startswith(F.trim("line"), F.lit("-"))).alias("examples"))
    parts = named.join(parts, blocks)
    out += [
        _fault(heads.where(known).join(stances, ["memory", "file", "section"], "left_anti"), "mode has no stance", None, F.col("mode")),
        _fault(stances, "stance has no count", F.col("side").isNull(), F.col("mode")),
        _fault(named, "side is not in the vocabulary", ~F.array_contains(sides, F.col("side")), here),
        _fault(named.join(counts, spot, "left").where(~kept), "kept with too few ledger lines and no correction", None, F.concat(here, F.lit(" "), F.coalesce("n", F.lit(0)).cast("string"))),
        _fault(parts, "stance has no way to apply it", ~F.col("applied"), here),
        _fault(parts, "stance has no examples", F.col("examples") == 0, here),
        _fault(parts, "stance has too many examples", F.col("examples") > MOST_EXAMPLES, here),
    ]
    examples = rows.join(named.select(*blocks), blocks, "left_semi").where(F.col("listed") & F.startswith(F.trim("line"), F.lit("-")) & ~F.col("line").rlike(GIST))
    date, quote = F.regexp_extract("line", EXAMPLE, 1), F.replace(F.regexp_extract("line", EXAMPLE, 2), F.lit('\\"'), F.lit('"'))
    examples = examples.withColumns({"date": date, "quote": F.when(date != "", quote)})
    quoted = examples.where("quote is not null")
    length = F.aggregate(F.filter(F.transform(F.split("quote", r"…|\.\.\."), squeezed), lambda s: s != ""), F.lit(0), lambda n, s: n + F.size(F.split(s, " ")))
    out += [
        _fault(examples, "example cannot be read", F.col("quote").isNull(), F.left(F.trim("line"), F.lit(60))),
        _fault(quoted, "example is dated after the session", F.col("date") > F.col("session_date"), F.col("date")),
        _fault(quoted, "example is too long", length > MOST_QUOTED, F.left("quote", F.lit(40))),
        _fault(not_recorded(quoted.select("memory", "file", "quote"), recordings), "example is not in the recordings", None, F.left("quote", F.lit(60))),
    ]
    # What the ledger keeps is in its note, as a stance or among its conflicts.
    conflicts = lines.where(_starts("Conflicts")).groupBy("memory", "file").agg(F.lower(F.array_join(F.collect_list("line"), " ")).alias("conflicts"))  # one note's
    homes = _map({t.code: t.file for t in topics})
    owed = counts.where(kept).withColumn("file", F.element_at(homes, F.col("code"))).where(F.array_contains(sides, F.col("side")))
    owed = owed.join(named.select(*spot).distinct(), spot, "left_anti").join(conflicts, ["memory", "file"], "left").where(~F.contains(F.coalesce("conflicts", F.lit("")), F.col("side")))
    out.append(_fault(owed, "kept stance is missing", None, F.concat(here, F.lit(" "), F.col("n").cast("string"))))
    out += _index_faults(files, notes, heads, topics, phases, intro, project_line)
    return _found(out)


def _index_faults(files: DataFrame, notes: DataFrame, heads: DataFrame, topics: list[Topic], phases: list[str], intro: str, project_line: str) -> list[tuple]:
    index = files.where(F.col("file") == INDEX)
    lines = index.select("memory", "file", F.posexplode(F.filter(F.split("text", "\r?\n"), lambda x: F.trim(x) != "")).alias("no", "line"))
    opening = lines.where("no < 2").groupBy("memory").agg(F.max(F.when(F.col("no") == 0, F.col("line"))).alias("a"), F.max(F.when(F.col("no") == 1, F.col("line"))).alias("b"))
    begun = index.select("memory", "file").join(opening, "memory", "left")
    w = W.partitionBy("memory").orderBy("no")
    head = F.when(_starts("## "), F.trim(F.expr("substr(line, 4)")))
    rows = lines.where("no >= 2").withColumns({"head": head, "phase": F.last(head, True).over(w)})
    rank = F.array_position(F.array(*map(F.lit, phases)), F.col("head")).cast("int")
    order = F.when(rank > 0, rank)
    most = F.max(order).over(w.rowsBetween(W.unboundedPreceding, -1))
    tops = rows.withColumns({"rank": order, "most": most}).where(F.col("head").isNotNull() & (F.col("head") != PROJECT))
    body = rows.where("head is null")
    project, rest = body.where(F.col("phase") == PROJECT), body.where(~F.coalesce(F.col("phase") == PROJECT, F.lit(False)))
    found = lambda k: F.nullif(F.regexp_extract("line", LINE, k), F.lit(""))
    entries = rest.withColumns({"code": found(1), "name": found(2), "target": found(3), "trigger": found(4)})
    good = entries.where("code is not null")
    same = F.element_at(_map({t.code: f"{t.name}\0{t.file}" for t in topics}), F.col("code")) == F.concat_ws("\0", "name", "target")
    listed = good.where(F.coalesce(same, F.lit(False)))
    home = F.element_at(_map({t.code: t.phase for t in topics}), F.col("code"))
    # The phrases of the modes that a note has, in its order.
    phrases = _map({f"{t.file}\0{m}": p for t in topics for m, p in t.phrases.items()})
    modes = heads.withColumn("p", F.element_at(phrases, F.concat_ws("\0", "file", "mode"))).groupBy("memory", F.col("file").alias("target")).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("section", "p")))), lambda s: s["p"]).alias("allowed"))
    there = notes.select("memory", F.col("file").alias("target")).join(modes, ["memory", "target"], "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>")))
    pointed = listed.join(there, ["memory", "target"]).withColumn("parts", F.split("trigger", "; "))
    in_order = F.filter("allowed", lambda p: F.array_contains("parts", p)) == F.col("parts")
    text = F.lower("text")
    sides = F.array(*[F.lit(s.lower()) for s in sorted({s for t in topics for s in t.sides})]) if any(t.sides for t in topics) else F.array().cast("array<string>")
    leaked = F.filter(sides, lambda s: F.regexp_like(text, F.concat(F.lit(r"(?<![\w-])\Q"), s, F.lit(r"\E(?![\w-])"))))
    contexts = files.where(F.col("file") == CONTEXT).select("memory").distinct()
    said = lines.where(F.col("line") == project_line).select("memory").distinct()
    return [
        _fault(begun, "index does not begin with the title and the introduction", ~(F.coalesce(F.col("a") == TITLE, F.lit(False)) & F.coalesce(F.col("b") == intro, F.lit(False)))),
        _fault(tops, "index heading is unknown", F.col("rank").isNull(), F.col("head")),
        _fault(tops, "index heading is out of order or repeated", F.col("rank") <= F.col("most"), F.col("head")),
        _fault(project, "project line is not the fixed one", F.col("line") != project_line),
        _fault(entries, "index line has another form", F.col("code").isNull(), F.left("line", F.lit(50))),
        _fault(good, "index line has another name or file than its topic", ~F.coalesce(same, F.lit(False)), F.col("code")),
        _fault(listed, "index line stands under another phase", ~F.coalesce(home == F.col("phase"), F.lit(False)), F.col("code")),
        _fault(listed.join(there, ["memory", "target"], "left_anti"), "index line points to a missing note", None, F.col("code")),
        _fault(pointed, "index line has too many phrases", F.size("parts") > MOST_MODES, F.col("code")),
        _fault(pointed, "index line's phrases are not those of the note, in order", ~in_order, F.col("code")),
        _fault(pointed, "index line leaves out a mode of the note", F.size("parts") < F.least(F.size("allowed"), F.lit(MOST_MODES)), F.col("code")),
        _fault(index.withColumn("leaked", leaked), "stance words in the index", F.size("leaked") > 0, F.array_join("leaked", ", ")),
        _fault(index, "quote marks in the index", F.col("text").rlike('["“”]')),
        _fault(notes.join(index.select("memory"), "memory", "left_semi").join(listed.select("memory", F.col("target").alias("file")), ["memory", "file"], "left_anti"), "note has no line in the index"),
        _fault(index.join(contexts, "memory", "left_semi").join(said, "memory", "left_anti"), "project line is missing"),
    ]
