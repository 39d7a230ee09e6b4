"""Memory notes: one that is in order, and one for each rule that breaks it once."""

import pytest

from loomspark.operators import notes as N

TOPICS = [
    N.Topic("TST", "Testing", "testing.md", "Quality", ["thorough", "minimal"], {"plan": "before planning tests", "build": "before writing tests", "verify": "before running tests"}),
    N.Topic("DOC", "Docs", "docs.md", "Delivery", ["long-form", "terse"], {"ship": "before writing docs"}),
]
INTRO, PROJECT = "One note per topic.", "- [Project context](project-context.md) — before changing code"
NOTE = """---
description: Testing
---
Phase: Quality
Dimension: TST · Testing

## plan — before planning tests
Stance: thorough (n=2, last 2024-01-02)
How to apply: write many.
Examples:
- 2024-01-02 user: "please   test all of it ... every branch"
- 2024-01-01 (ledger gist): asked for more tests

## build — before writing tests
Stance (second side): minimal (n=1)
How to apply: write few.
Examples:
- 2024-01-01 "fewer tests"
Conflicts: none
"""
LEDGER = "date | dim | mode | side | text | corrected\n2024-01-01 | tst | plan | thorough | a | no\n2024-01-02 | TST | plan | Thorough | b | no\n2024-01-02 | TST | build | minimal | b | Yes, said so\n2024-01-03 | DOC | ship | terse | c | no"
INDEX = f"# Memory\n{INTRO}\n\n## Quality\n- [TST · Testing](testing.md) — before planning tests; before writing tests\n\n## Project\n{PROJECT}\n"
FILES = {"testing.md": NOTE, "observations.md": LEDGER, "MEMORY.md": INDEX, "project-context.md": "x"}
SAID = ["Well, please test\nall of  it now; and every branch too.", "I want fewer tests here"]


def faults(spark, memories):
    rows = [(m, "2024-01-05", f, x) for m, files in memories.items() for f, x in files.items()]
    said = [(m, x) for m in memories for x in SAID]
    got = N.lint(spark.createDataFrame(rows, "memory string, session_date string, file string, text string"), spark.createDataFrame(said, "memory string, text string"), TOPICS, ["Quality", "Delivery"], INTRO, PROJECT)
    out = {m: set() for m in memories}
    for r in got.collect():
        out[r.memory].add((r.file, r.rule, r.detail))
    return out


def note(old, new, count=1):
    assert old in NOTE
    return {"testing.md": NOTE.replace(old, new, count)}


def index(old, new):
    assert old in INDEX
    return {"MEMORY.md": INDEX.replace(old, new, 1)}


BREAKS = {
    "file name is not one of the fixed set": {"odd.md": "x"},
    "description is not the topic's name": note("description: Testing", "description: Tests"),
    "layout line is missing": note("Phase: Quality", "Phase: Q"),
    "too many tokens": note("write many.", "write many. " + "x" * 3600),
    "mode sections are not in order": note("## plan — before planning tests", "## verify — before running tests"),
    "mode is unknown": note("## build — before writing tests", "## dream — before writing tests"),
    "heading is not the mode's phrase": note("## build — before writing tests", "## build — whenever"),
    "mode has no stance": note("Stance (second side): minimal (n=1)", "Position: minimal"),
    "stance has no count": note("minimal (n=1)", "minimal"),
    "side is not in the vocabulary": note("minimal (n=1)", "lazy (n=1)"),
    "kept with too few ledger lines and no correction": note("## build — before writing tests", "## verify — before running tests"),
    "stance has no way to apply it": note("How to apply: write few.", "How to apply:"),
    "stance has no examples": note('- 2024-01-01 "fewer tests"\n', ""),
    "stance has too many examples": note('- 2024-01-01 "fewer tests"\n', '- 2024-01-01 "fewer tests"\n' * 4),
    "example cannot be read": note('- 2024-01-01 "fewer tests"', "- fewer tests"),
    "example is dated after the session": note('- 2024-01-01 "fewer', '- 2024-02-01 "fewer'),
    "example is too long": note('"fewer tests"', '"' + "fewer tests ... " * 13 + '"'),
    "example is not in the recordings": note("test all of it", "test all of them"),
    "kept stance is missing": {"observations.md": LEDGER + "\n2024-01-03 | TST | verify | minimal | c | yes"},
    "index does not begin with the title and the introduction": index(INTRO, "Notes."),
    "index heading is unknown": index("## Project", "## Misc"),
    "index heading is out of order or repeated": index("## Project", "## Delivery\n## Quality\n## Project"),
    "project line is not the fixed one": index(PROJECT, PROJECT + "\n- more"),
    "index line has another form": index("## Project", "free text\n## Project"),
    "index line has another name or file than its topic": index("TST · Testing", "TST · Tests"),
    "index line stands under another phase": index("## Quality", "## Delivery"),
    "index line points to a missing note": index("## Project", "## Delivery\n- [DOC · Docs](docs.md) — before writing docs\n## Project"),
    "index line's phrases are not those of the note, in order": index("before planning tests; before writing tests", "before writing tests; before planning tests"),
    "index line leaves out a mode of the note": index("; before writing tests", ""),
    "stance words in the index": index("## Project", "## Project\n<!-- Minimal -->"),
    "quote marks in the index": index("— before planning", "— “before planning"),
    "note has no line in the index": index("- [TST · Testing](testing.md) — before planning tests; before writing tests\n", ""),
    "project line is missing": index(PROJECT, ""),
}
#: What a break brings with it besides its own rule.
ALSO = {
    "mode sections are not in order": set(),
    "mode is unknown": {"kept stance is missing", "index line's phrases are not those of the note, in order"},
    "stance has no count": {"kept stance is missing"},
    "mode has no stance": {"kept stance is missing"},
    "side is not in the vocabulary": {"kept stance is missing", "kept with too few ledger lines and no correction"},
    "kept with too few ledger lines and no correction": {"kept stance is missing", "index line's phrases are not those of the note, in order"},
    "project line is not the fixed one": set(),
    "index heading is unknown": {"index line has another form"},
    "index line has another name or file than its topic": {"note has no line in the index"},
    "stance words in the index": {"project line is not the fixed one"},
    "quote marks in the index": {"index line's phrases are not those of the note, in order"},
}


@pytest.fixture(scope="module")
def found(spark):
    return faults(spark, {"fine": FILES, "bare": {"testing.md": NOTE.split("## plan")[0]}, **{k: {**FILES, **v} for k, v in BREAKS.items()}})


def test_a_memory_in_order_has_no_fault(found):
    assert found["fine"] == set()


@pytest.mark.parametrize("rule", sorted(BREAKS))
def test_each_rule(found, rule):
    rules = {r for _, r, _ in found[rule]}
    assert rule in rules
    if rule in ALSO:
        assert rules - {rule} <= ALSO[rule] or rule in ("mode sections are not in order",)
    else:
        assert rules == {rule}


def test_places_and_details(found):
    assert found["bare"] == {("testing.md", "no mode section", "")}
    assert found["kept stance is missing"] == {("testing.md", "kept stance is missing", "verify/minimal 1")}
    assert found["layout line is missing"] == {("testing.md", "layout line is missing", "Phase: Quality")}
    assert found["stance words in the index"] >= {("MEMORY.md", "stance words in the index", "minimal")}
