import json

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as x


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("v")).first()["v"]


def test_chunks_follow_headings():
    note = "---\ntitle: T\n---\nintro\n\n# A\ntext\n## B\nmore\n### C\n\n## D\nend"
    assert x.split_note(note) == [("(intro)", "intro", 0), ("# A", "# A\ntext", 1), ("# A > ## B", "## B\nmore", 2), ("# A > ## B > ### C", "### C", 3), ("# A > ## D", "## D\nend", 4)]
    assert x.split_note("") == [] and x.split_note("  \n ") == []


def test_long_sections_are_cut_hard():
    parts = x.split_note("# H\n" + "x" * 4500)
    assert [len(c) for _, c, _ in parts] == [2000, 2000, 504] and [p for _, _, p in parts] == [0, 1, 2]


def test_frontmatter():
    assert x.split_frontmatter("---\na: [1\n---\nrest") == ({}, "rest")
    assert x.split_frontmatter("no block") == ({}, "no block")
    assert x.split_frontmatter("---\na: 1\n---\nrest") == ({"a": 1}, "rest")


def test_udfs(spark):
    df = spark.createDataFrame([(1, "---\ndate: 2026-01-15\n---\n# A\nb"), (2, None), (3, "")], "id int, text string")
    got = {r["id"]: r for r in df.select("id", x.heading_chunks("text").alias("c"), x.frontmatter_json("text").alias("f")).collect()}
    assert [c["heading_path"] for c in got[1]["c"]] == ["# A"] and json.loads(got[1]["f"]) == {"date": "2026-01-15"}
    assert got[2]["c"] == [] and got[2]["f"] is None and got[3]["c"] == []


@pytest.mark.parametrize("text,links", [("[[a]] [[b|c]] [[d#h]] [[a]]", ["a", "b"]), ("none", []), ("", [])])
def test_links(spark, text, links):
    assert one(spark, x.wiki_links(F.col("t")), t=text) == links


def test_density_and_link_sections(spark):
    assert one(spark, x.link_density(F.col("t")), t="[[ab]]xxxxxx") == 0.5
    assert one(spark, x.link_density(F.col("t")), t="") == 0
    prose = "word " * 20
    for heading, content, want in (("# A > ## Related notes", "[[abcd]] " + "x" * 40, True), ("# A > ## Related Work", prose, False), ("# A > ## Prose", "[[abcd]] " + "x" * 40, False), (None, "[[abcd]] xx", True)):
        assert one(spark, x.is_link_section(F.col("h"), F.col("c")), h=heading, c=content) is want


@pytest.mark.parametrize(
    "role,text,kind",
    [("user", "no, that is not what I asked you to do here", "convention"), ("assistant", "The root cause was a missing index in the table", "bug"), ("assistant", "We decided to use the second approach for it all", "decision"),
     ("assistant", "It turns out that the cache is never invalidated", "learning"), ("assistant", "The key is stored at the usual place in the vault", "context"), ("assistant", "root cause", None), ("assistant", "Nothing of note is said in this sentence at all", None)],
)
def test_classes(spark, role, text, kind):
    assert one(spark, x.classify(F.col("t"), F.col("r")), t=text, r=role) == kind


def test_summary_and_tags(spark):
    assert one(spark, x.first_sentence(F.col("t")), t="  This is the first\nsentence. And more.") == "This is the first sentence."
    assert len(one(spark, x.first_sentence(F.col("t")), t="x" * 500)) == 200
    assert one(spark, x.path_tags(F.col("t")), t="see src/app/main.py and docs/a.md, x.zip") == ["app", "docs", "md", "py"]
    assert one(spark, x.ancestors(F.col("t")), t="a/b/c.md") == ["a/b", "a"]
    assert [one(spark, x.unsafe_path(F.col("t")), t=p) for p in ("a/b.md", "/a.md", "a/../b.md", ".git/x.md", "a.txt")] == [False, True, True, True, True]


def test_stems():
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "relational": "relat", "conditional": "condit", "happy": "happi", "electrical": "electr", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "sky": "sky", "feed": "feed"}
    assert {w: x.stem(w) for w in want} == want
    assert x.stem("größe") == "größe" and x.stem("is") == "is"


def test_fold(spark):
    assert one(spark, x.fold("t"), t="Crème BRÛLÉE") == "creme brulee"
