from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import splitting as s

SCHEMA = "chunk_id long, heading_path string, content string, position int, piece string, start int"


def check(text, limit, overlap):
    parts = s.pieces(text, limit, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    assert all(0 < e - b <= limit for b, e in parts)
    assert all(b == e0 - overlap for (_, e0), (b, _) in zip(parts, parts[1:]))
    assert "".join(text[max(b, prev) : e] for (b, e), prev in zip(parts, [0] + [e for _, e in parts])) == text
    return parts


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n#-\r`é漢", min_size=1, max_size=900))
def test_pieces_cover_and_overlap(text):
    check(text, 100, 10)


def test_natural_places():
    text = "# A\n\n" + "word " * 25 + "\n\n## B\n\n" + "Sentence here. " * 12
    parts = check(text, 200, 20)
    assert text[parts[0][1] :].startswith("## B")
    assert all(text[e - 1] in " \n" or e == len(text) for _, e in parts)


def test_equals_cutting_one_after_another():
    text = "Lorem ipsum dolor. Sit amet\n\n" * 300
    table = s.successors(text, 200, 20)
    at, ends = 20, []
    while at < len(text):
        at = int(table[at])
        ends.append(at)
    assert s.cut_points(text, 200, 20).tolist() == ends


def test_without_boundaries():
    parts = check("x" * 10_000, 2000, 200)
    assert parts[0] == (0, 2000) and parts[1] == (1800, 3800)


def test_operator(spark):
    long = "para one. " * 300
    rows = [(1, "h", long, 3, "", 0), (1, "h", long, 3, "", 0), (2, None, "short", 0, "", 0), (3, None, None, None, "", 0), (4, "h", " " * 5000, 1, "", 0), (5, None, "y" * 2001, None, "", 0), (6, "h", " \n" + "z" * 2000 + "\t ", 1, "", 0)]
    got = sorted(s.split_oversized(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: (r["chunk_id"], r["piece"]))
    assert {r["chunk_id"] for r in got} == {1, 5}
    one = [r for r in got if r["chunk_id"] == 1]
    assert [r["position"] for r in one] == [3, 4] and all(r["heading_path"] == "h" and r["content"] == long.strip()[r["start"] : r["end"]] for r in one)
    assert [r["position"] for r in got if r["chunk_id"] == 5] == [0, 1]
    assert s.split_oversized(spark.createDataFrame([], SCHEMA)).count() == 0
