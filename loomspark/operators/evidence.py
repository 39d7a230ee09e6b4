"""Linking edits to commits, and reading nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import head_and_tail, plain_name
from .diffs import edge_confidence, edit_delta, patch_sections, text_recall, unified_patch
from .joins import suffix_meetings

# The plain names of each family of tools, and how much of such a call is shown.
FAMILIES = (
    ("orchestration", "marker", ("taskcreate", "taskupdate", "tasklist", "taskoutput", "taskstop", "todowrite", "teamcreate", "teamdelete", "toolsearch")),
    ("planning", "full", ("askuserquestion", "enterplanmode", "exitplanmode", "skill")),
    ("subagent", "full", ("agent", "task", "sendmessage")),
    ("local_research", "compact", ("read", "readfile", "grep", "glob", "ls", "listdirectory", "findfile", "findsymbol", "findreferencingsymbols")),
    ("shell", "full", ("bash", "shell", "runshellcommand", "execute", "exec")),
    ("code_write", "full", ("edit", "write", "multiedit", "notebookedit", "applypatch", "writefile", "editfile", "replace")),
)
# The tools that write files, the names under which their payloads hold a path and old and new text, and
# the fields of a snapshot.
WRITERS = ("write", "edit", "multiedit", "notebookedit", "applypatch", "apply_patch", "write_file", "edit_file", "replace")
PATHS = ("file_path", "filePath", "path")
OLD = ("old_string", "oldString", "old_text", "oldText")
NEW = ("new_string", "newString", "new_text", "newText")
PATCHES = ("patchText", "patch_text", "patch")
SNAPSHOT_MAPS = ("files", "trackedFiles", "fileContents", "trackedFileBackups")
SNAPSHOT_TEXTS = ("content", "contents", "file_content", "fileContent", "text")


def tool_family(name: Column) -> Column:
    """A struct (family, shown) of a tool's name; a null name is like an unknown one."""
    plain = F.coalesce(plain_name(name), F.lit(""))
    both = lambda family, shown: F.struct(F.lit(family).alias("family"), F.lit(shown).alias("shown"))
    out = F.when(F.startswith(plain, F.lit("web")) | F.contains(plain, F.lit("browser")) | F.contains(plain, F.lit("chrome")), both("external_or_browser", "compact")).otherwise(both("generic", "compact"))
    for family, shown, names in reversed(FAMILIES):
        hit = plain.isin(*names)
        if family == "shell":
            hit = hit | F.contains(plain, F.lit("contextmodeexecute"))
        out = F.when(hit, both(family, shown)).otherwise(out)
    return out


def present(v: Column, names: tuple[str, ...]) -> Column:
    """The first field of a variant object that is there, a JSON null included, as text."""
    return F.try_variant_get(F.coalesce(*[F.try_variant_get(v, f"$.{n}", "variant") for n in names]), "$", "string")


def write_actions(df: DataFrame, keys: list[str], tool: str, payload: str, file_path: str | None = None) -> DataFrame:
    """keys, action, path, operation, added, deleted: a row for each file edit that a tool call holds.

    A payload is a JSON object: a patch text of several files; or a path (that of the call goes first) with old and new
    text, or with a list `edits` of such. Entries of the list that are no objects keep their number but give no row. An
    edit without old text is a write. Other tools, payloads and edits without a path give no row.
    """
    name = F.replace(F.lower(F.coalesce(tool, F.lit(""))), F.lit("-"), F.lit("_"))
    compact = F.replace(name, F.lit("_"), F.lit(""))
    body = F.try_parse_json(payload)
    calls = df.select(*keys, compact.alias("__tool"), name.alias("__name"), body.alias("__b"), (F.col(file_path) if file_path else F.lit(None).cast("string")).alias("__f"))
    calls = calls.where((F.col("__name").isin(*WRITERS) | F.col("__tool").isin(*WRITERS)) & F.schema_of_variant("__b").startswith("OBJECT"))
    patches = calls.where("__tool = 'applypatch'").select(*keys, F.posexplode(patch_sections(present(F.col("__b"), PATCHES))).alias("action", "p")).select(*keys, "action", "p.path", "p.operation", "p.added", "p.deleted")
    path = F.coalesce(F.nullif("__f", F.lit("")), present(F.col("__b"), PATHS))
    edits = F.coalesce(F.try_variant_get("__b", "$.edits", "array<variant>"), F.array("__b"))
    rows = calls.where("__tool <> 'applypatch'").select(*keys, path.alias("path"), F.posexplode(edits).alias("action", "e")).where("path <> ''").where(F.schema_of_variant("e").startswith("OBJECT"))
    old, new = F.coalesce(present(F.col("e"), OLD), F.lit("")), F.coalesce(present(F.col("e"), NEW), present(F.col("e"), ("content",)), F.lit(""))
    done = rows.select(*keys, "action", "path", F.when(old == "", "write").otherwise("edit").alias("operation"), edit_delta(old, new).alias("d"))
    return patches.unionByName(done.select(*keys, "action", "path", "operation", "d.added", "d.deleted"))


def prompt_of_action(df: DataFrame, keys: list[str], turn: str, is_prompt: Column) -> DataFrame:
    """Adds user_turn: the last prompt at or before each row; null before the first one."""
    w = W.partitionBy(*keys).orderBy(turn).rangeBetween(W.unboundedPreceding, 0)
    return df.withColumn("user_turn", F.max(F.when(is_prompt, F.col(turn))).over(w))


def matched_edges(actions: DataFrame, commits: DataFrame, by: list[str], action_keys: list[str], commit: str, patch: str, attribution: str) -> DataFrame:
    """An edge for each action and commit of the same `by` where the commit has the action's file.

    actions: by, action_keys, path, added, deleted. commits: by, commit, patch (a unified diff), attribution (JSON).
    Result: by, action_keys, commit, commit_path, added_recall, deleted_recall, changed_text_recall, survival_recall,
    confidence, share. The file is found by the longest path at the end of the action's, else by a name that only one
    file has. New text that a commit has decides; old text only where there is no new one.
    """
    files = unified_patch(commits.select(*by, commit, patch), [*by, commit], patch)
    found = suffix_meetings(actions.select(*by, *action_keys, "path"), files.select(*by, commit, F.col("path").alias("candidate")), by, "path", "candidate", action_keys, [commit])
    sides = files.select(*by, commit, F.col("path").alias("matched"), F.col("added").alias("__a"), F.col("deleted").alias("__d"))
    rows = found.join(actions, [*by, *action_keys]).join(sides, [*by, commit, "matched"])
    scored = rows.select(*by, *action_keys, commit, F.col("matched").alias("commit_path"), "added", "deleted", text_recall(F.col("added"), F.col("__a")).alias("ra"), text_recall(F.col("deleted"), F.col("__d")).alias("rd"))
    has_a, has_d = F.size("added") > 0, F.size("deleted") > 0
    survival = F.when(has_a, F.col("ra")).otherwise(F.col("rd"))
    changed = F.when(has_a & has_d, (F.col("ra") + F.col("rd")) / 2).when(has_a, F.col("ra")).when(has_d, F.col("rd")).otherwise(0.0)
    out = scored.select(*by, *action_keys, commit, "commit_path", F.round("ra", 4).alias("added_recall"), F.round("rd", 4).alias("deleted_recall"), F.round(changed, 4).alias("changed_text_recall"), F.round(survival, 4).alias("survival_recall"), edge_confidence(F.lit(True), survival, has_a | has_d).alias("confidence"))
    shares = attributions(commits.select(*by, commit, attribution), [*by, commit], attribution, False).select(*by, commit, F.col("path").alias("commit_path"), "share")
    return out.join(shares, [*by, commit, "commit_path"], "left").withColumn("share", F.coalesce("share", F.lit("")))


def snapshot_files(df: DataFrame, keys: list[str], json: str, most: int = 8000) -> DataFrame:
    """keys, path, content of the files whose text a snapshot holds, shortened to head and tail. Backups are references:
    of their map only records with a text count."""
    v = F.try_parse_json(json)
    body = F.coalesce(F.try_variant_get(v, "$.snapshot", "variant"), v)
    maps = F.array(*[F.struct(F.lit(n).alias("kind"), F.try_variant_get(body, f"$.{n}", "map<string, variant>").alias("m")) for n in SNAPSHOT_MAPS])
    rows = df.select(*keys, F.explode(maps).alias("c")).where("c.m is not null").select(*keys, "c.kind", F.explode("c.m").alias("path", "v"))
    kind = F.schema_of_variant("v")
    texts = F.coalesce(*[F.when(F.schema_of_variant(F.try_variant_get("v", f"$.{n}", "variant")) == "STRING", F.try_variant_get("v", f"$.{n}", "string")) for n in SNAPSHOT_TEXTS])
    content = F.when((kind == "STRING") & (F.col("kind") != "trackedFileBackups"), F.try_variant_get("v", "$", "string")).when(F.startswith(kind, F.lit("OBJECT")), texts)
    return rows.select(*keys, "path", head_and_tail(content, most).alias("content")).where("content is not null")


def found_nested(df: DataFrame, keys: list[str], json: str, wanted: list[str], depth: int = 12) -> DataFrame:
    """keys, record: the JSON objects, at any place of a document, that have all the wanted fields. Level by level; a
    document of more than `depth` levels is an error, which the result's reading raises."""
    level = df.select(*keys, F.try_parse_json(json).alias("v")).where("v is not null")
    has = lambda v: F.lit(True) if not wanted else F.forall(F.array(*[F.try_variant_get(v, f"$.{w}", "variant").isNotNull() for w in wanted]), lambda x: x)
    out = None
    for _ in range(depth):
        hit = level.where(has(F.col("v"))).select(*keys, F.to_json("v").alias("record"))
        out = hit if out is None else out.unionByName(hit)
        children = F.coalesce(F.map_values(F.try_variant_get("v", "$", "map<string, variant>")), F.try_variant_get("v", "$", "array<variant>"))
        level = level.where(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")).select(*keys, F.explode(children).alias("v"))
    return out.unionByName(level.select(*keys, F.raise_error(F.lit(f"a document has more than {depth} levels")).cast("string").alias("record")))


def attributions(df: DataFrame, keys: list[str], json: str, without_total: bool = True) -> DataFrame:
    """keys, path, share, complete of a JSON map from paths to records or to plain labels; the total is left out."""
    rows = df.select(*keys, F.explode(F.try_variant_get(F.try_parse_json(json), "$", "map<string, variant>")).alias("path", "v"))
    rows = rows.where("path <> '__aggregate__'") if without_total else rows
    share = F.coalesce(F.try_variant_get("v", "$.attribution", "string"), F.try_variant_get("v", "$", "string"))
    both = F.try_variant_get("v", "$.agent_version", "string").isNotNull() & F.try_variant_get("v", "$.committed_version", "string").isNotNull()
    return rows.select(*keys, "path", share.alias("share"), both.alias("complete"))


def best_edges(edges: DataFrame, keys: list[str], confidence: str, recall: str) -> DataFrame:
    """keys, n_edges, best (the highest label by rank), mean_recall; null keys stay groups of their own."""
    ladder = ["weak", "moderate", "strong", "exact"]
    rank = F.array_position(F.array(*map(F.lit, ladder)), F.col(confidence))
    return edges.groupBy(*keys).agg(F.count("*").alias("n_edges"), F.max(rank).alias("r"), F.avg(recall).alias("mean_recall")).select(*keys, "n_edges", F.get(F.array(*map(F.lit, ladder)), (F.col("r") - 1).cast("int")).alias("best"), "mean_recall")


def changed_after_last_seen(df: DataFrame, keys: list[str], order: str, kind: str, content: str, now: str) -> DataFrame:
    """keys, state: whether what was last seen of a file is still what is there now."""
    last = F.max_by(F.struct(kind, content), F.col(order))
    per = df.groupBy(*keys).agg(last.alias("l"), F.max(now).alias("now"))
    return per.select(*keys, F.when(F.col("now").isNull(), "gone").when(F.col(f"l.{content}") == F.col("now"), "same").otherwise("changed").alias("state"))


def reward_gates(checks: DataFrame, gates: DataFrame, case: str, gate: str, outcome: str) -> DataFrame:
    """case, gate, passed of every expected gate: outcomes are said in many ways; one without a check is null."""
    said = F.lower(F.trim(outcome))
    passed = F.when(said.isin("pass", "passed", "true", "ok", "1"), True).when(said.isin("fail", "failed", "false", "error", "0"), False)
    return gates.join(checks.withColumn("passed", passed).select(case, gate, "passed"), [case, gate], "left")


def required_match(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join that fails where a row of left finds nothing."""
    met = left.join(right.withColumn("__there", F.lit(True)), on, "left")
    first = met.columns[0]
    return met.withColumn(first, F.when(F.col("__there"), F.col(first)).otherwise(F.raise_error(F.concat(F.lit("no match for "), F.concat_ws(",", *[F.col(c).cast("string") for c in on]))))).drop("__there")


def band_overlap(calls: DataFrame, files: DataFrame, key: str, other: str, path: str) -> DataFrame:
    """key, other, shared, share: how many of a band's edited paths each commit has."""
    edited = calls.select(key, path).distinct()
    n = edited.groupBy(key).agg(F.count("*").alias("__n"))
    shared = edited.join(files.select(key, other, path).distinct(), [key, path]).groupBy(key, other).agg(F.count("*").alias("shared"))
    return shared.join(n, key).select(key, other, "shared", F.try_divide(F.col("shared").cast("double"), F.col("__n")).alias("share"))


def kept_for_strict(df: DataFrame, keys: list[str], strict: Column, order: list[Column], n: int) -> DataFrame:
    """n rows of each key: those that pass the strict test first, others only to fill up; `backfill` marks these."""
    s = F.coalesce(strict, F.lit(False))
    w = W.partitionBy(*keys).orderBy(s.desc(), *order)
    return df.withColumns({"backfill": ~s, "__n": F.row_number().over(w)}).where(F.col("__n") <= n).drop("__n")
