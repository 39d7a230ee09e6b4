"""Column functions on text and paths. All stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeezed(x: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def meaningful_lines(x: Column) -> Column:
    """The squeezed, non-empty lines."""
    return F.filter(F.transform(F.split(x, r"\r\n|\r|\n"), squeezed), lambda y: y != "")


def clipped(x: Column, most: int, suffix: str = "...") -> Column:
    """At most `most` characters, the suffix counted."""
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most - len(suffix))), F.lit(suffix))).otherwise(x)


def head_and_tail(x: Column, most: int, marker: str = " [...] ", head: float = 2 / 3) -> Column:
    """The start and the end of a long text around a marker, `most` characters in all."""
    room = most - len(marker)
    first = int(room * head)
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(first)), F.lit(marker), F.right(x, F.lit(room - first)))).otherwise(x)


def first_line(x: Column) -> Column:
    """Empty for an empty text."""
    return F.coalesce(F.try_element_at(F.split(x, r"\r\n|\r|\n"), F.lit(1)), F.lit(""))


def basename(x: Column) -> Column:
    return F.element_at(F.split(F.replace(x, F.lit("\\"), F.lit("/")), "/"), -1)


def plain_name(x: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def word_count(x: Column) -> Column:
    return F.when(F.trim(x) == "", F.lit(0)).otherwise(F.size(F.split(squeezed(x), " "))).cast("long")


def first_words(x: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(squeezed(x), " "), 1, n), " ")


def token_estimate(x: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.expr("0") + ((F.length(x) + 3) / 4).cast("long")


def slug(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9]", "-")


def after(x: Column, marker: str) -> Column:
    """All that follows a marker, across lines; empty without it."""
    return F.regexp_extract(x, rf"(?s){marker}(.*)", 1)


# Forms of credentials, in the order in which they are replaced, and what stands in for them.
SECRETS = (
    (r"sk-(?:proj-)?[A-Za-z0-9_-]{20,}", "[REDACTED_OPENAI_KEY]"),
    (r"AIza[0-9A-Za-z_-]{30,}", "[REDACTED_GOOGLE_KEY]"),
    (r"AKIA[0-9A-Z]{16}", "[REDACTED_AWS_KEY]"),
    (r"gh(?:p|o|u|s|r)_[A-Za-z0-9]{20,}", "[REDACTED_GITHUB_TOKEN]"),
    (r"github_pat_[A-Za-z0-9_]{40,}", "[REDACTED_GITHUB_TOKEN]"),
    (r"xox(?:b|a|p|r|s)-[A-Za-z0-9-]{10,}", "[REDACTED_SLACK_TOKEN]"),
)


def redacted(x: Column) -> tuple[Column, Column]:
    """The text with credentials replaced, and how many were. Binary content (it holds a NUL) stays as it is."""
    binary, n, out = F.contains(x, F.lit("\0")), F.lit(0), x
    for pattern, marker in SECRETS:
        n = n + F.regexp_count(out, F.lit(pattern))
        out = F.regexp_replace(out, pattern, marker)
    return F.when(binary, x).otherwise(out), F.when(binary, F.lit(0)).otherwise(n).cast("long")


def pseudonym(x: Column, salt: str) -> Column:
    return F.concat(F.lit("user_"), F.substring(F.sha2(F.concat(F.lit(salt), F.lit("\0"), x).cast("binary"), 256), 1, 12))


def joined_hash(*parts: Column) -> Column:
    """SHA-256 of several fields, parted by NUL."""
    return F.sha2(F.concat_ws("\0", *parts).cast("binary"), 256)


def multiset_recall(needle: Column, haystack: Column) -> Column:
    """Share of the needle's entries, repeats counted, that the haystack has; 1 for an empty needle. Null entries match none.

    Both arrays are sorted and merged within the row: no shuffle, and steps as many as there are entries.
    """
    known = lambda x: F.sort_array(F.filter(x, lambda y: y.isNotNull()))

    def step(s: Column, m: Column) -> Column:
        x, y = F.get(s["a"], m["i"]), F.get(s["b"], m["j"])
        both = F.when(x.isNull() | y.isNull(), 0)  # one side is at its end
        up = lambda goes: both.when(goes, 1).otherwise(0)
        return F.struct((m["i"] + up(x <= y)).alias("i"), (m["j"] + up(y <= x)).alias("j"), (m["n"] + up(x == y)).alias("n"))

    def of(s: Column) -> Column:
        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("n"))
        steps = F.array_repeat(F.lit(0), F.size(s["a"]) + F.size(s["b"]))
        hits = F.aggregate(steps, start, lambda m, _: step(s, m), lambda m: m["n"])
        return F.when(s["size"] == 0, F.lit(1.0)).otherwise(hits / F.nullif(s["size"], F.lit(0)))

    # One element, so that both arrays are made once and not for every step.
    return F.get(F.transform(F.array(F.struct(known(needle).alias("a"), known(haystack).alias("b"), F.size(needle).alias("size"))), of), F.lit(0))


def json_list(x: Column) -> Column:
    """A JSON list as strings; a scalar as a list of one; null and bad input as an empty list."""
    return F.coalesce(F.when(F.trim(x).startswith("["), F.from_json(x, "array<string>")).when(F.trim(x) != "", F.array(x)), F.array().cast("array<string>"))
