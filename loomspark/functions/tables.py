"""Table functions for SQL text: one row to many, with LATERAL.

register(spark) makes them known to the session: patch_files, numstat_lines and meaningful_lines are SQL functions that
Catalyst inlines; write_actions needs sequence matching and runs in Arrow workers.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.diffs import line_delta
from ..operators.evidence import NEW, OLD, PATCHES, PATHS, WRITERS

_SQUEEZED = "trim(regexp_replace({x}, '\\\\s+', ' '))"
_SAID = "filter(transform(filter(split(section, '\\n'), y -> startswith(y, '{mark}')), y -> " + _SQUEEZED.format(x="substring(y, 2)") + "), y -> y <> '')"
_HEAD = "^\\\\*\\\\*\\\\* (Add|Update|Delete) File: (.+)$"

#: Name, arguments, columns and body of each SQL function.
SQL = {
    "patch_files": (
        "patch STRING",
        "position INT, operation STRING, path STRING, added ARRAY<STRING>, deleted ARRAY<STRING>",
        f"""SELECT p, lower(regexp_extract(split(section, '\\n')[0], '{_HEAD}', 1)), trim(regexp_extract(split(section, '\\n')[0], '{_HEAD}', 2)), {_SAID.format(mark='+')}, {_SAID.format(mark='-')}
        FROM posexplode(filter(split(regexp_replace(patch, '\\r\\n?', '\\n'), '(?m)^(?=\\\\*\\\\*\\\\* (?:Add|Update|Delete) File: .)'), x -> x rlike '^\\\\*\\\\*\\\\* (Add|Update|Delete) File: (.+)')) AS t(p, section)""",
    ),
    "numstat_lines": (
        "listing STRING",
        "path STRING, added BIGINT, deleted BIGINT, binary BOOLEAN",
        "SELECT f[2], coalesce(try_cast(f[0] AS BIGINT), 0), coalesce(try_cast(f[1] AS BIGINT), 0), f[0] = '-' FROM explode(transform(split(listing, '\\r?\\n'), x -> split(trim(x), '\\t|,|\\\\s+', 3))) AS t(f) WHERE size(f) = 3 AND f[0] rlike '^([0-9]+|-)$'",
    ),
    "meaningful_lines": (
        "body STRING",
        "position INT, line STRING",
        "SELECT p, x FROM posexplode(filter(transform(split(body, '\\r\\n|\\r|\\n'), y -> " + _SQUEEZED.format(x="y") + "), y -> y <> '')) AS t(p, x)",
    ),
}

_FILE = re.compile(r"\*\*\* (Add|Update|Delete) File: (.+)$")


def _shown(value) -> str | None:
    """A JSON value as text."""
    return value if value is None or isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def _field(body: dict, names: tuple[str, ...]) -> str | None:
    """The first field that is there, a null one included."""
    return next((_shown(body[n]) for n in names if n in body), None)


def _sections(patch: str):
    kind = path = None
    added: list[str] = []
    deleted: list[str] = []
    for line in re.sub("\r\n?", "\n", patch).split("\n"):
        head = _FILE.match(line)
        if head:
            if kind:
                yield kind, path, added, deleted
            kind, path, added, deleted = head[1].lower(), head[2].strip(" "), [], []
        elif kind and line[:1] in ("+", "-"):
            said = " ".join(line[1:].split())
            if said:
                (added if line[0] == "+" else deleted).append(said)
    if kind:
        yield kind, path, added, deleted


class WriteActions:
    def eval(self, tool: str, payload: str, file_path: str):
        name = (tool or "").lower().replace("-", "_")
        if name not in WRITERS and name.replace("_", "") not in WRITERS:
            return
        try:
            body = json.loads(payload or "")
        except ValueError:
            return
        if not isinstance(body, dict):
            return
        if name.replace("_", "") == "applypatch":
            for k, (operation, path, added, deleted) in enumerate(_sections(_field(body, PATCHES) or "")):
                yield k, path, operation, added, deleted
            return
        path = file_path or _field(body, PATHS)
        edits = body["edits"] if isinstance(body.get("edits"), list) else [body]
        for k, edit in enumerate(edits):
            if path and isinstance(edit, dict):
                old, new = _field(edit, OLD) or "", _field(edit, NEW)
                added, deleted = line_delta(old, (_field(edit, ("content",)) if new is None else new) or "")
                yield k, path, "edit" if old else "write", added, deleted


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session."""
    for name, (arguments, columns, body) in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE({columns}) RETURN {body}")
    spark.udtf.register("write_actions", udtf(WriteActions, returnType="action int, path string, operation string, added array<string>, deleted array<string>", useArrow=True))
