"""Text expressions: tokens, links, density, summaries, tags, classes. Python only where no expression exists."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}]+"
LINK = r"\[\[([^\]|#]+?)(?:[|][^\]]+?)?\]\]"
ANY_LINK = r"\[\[[^\]]+\]\]"
MAX_CHUNK = 2000

# Leaf headings that name a list of links.
LINK_HEADINGS = ("related", "see also", "see-also", "backlinks", "links", "references", "index", "contents", "table of contents", "moc")

# Patterns of the classes, in the order in which they are tried.
CORRECTION = r"(?i)^(wait|no[,. !]|don.t|stop|wrong|instead|actually|not that|I said|I meant|that.s not)"
CLASSES = (
    ("bug", r"(?i)\b(root cause|fixed by|bug fix|traceback|stack trace|the fix was|error was|the issue was|broke because|failed because|workaround|regression|the problem was)\b"),
    ("decision", r"(?i)\b(decided to|switched from|chose .+ over|going with|opting for|approach:|architecture:|design:|we.ll use|plan is to|recommended|the flow is|pipeline:|strategy:)\b"),
    ("convention", r"(?i)\b(always use|never use|rule:|convention:|must always|must never|important:|careful:|warning:|don.t forget|make sure to|remember to)\b"),
    ("learning", r"(?i)\b(discovered that|turns out|TIL:|learned that|found that|the reason is|key finding|it.s actually|didn.t know|wasn.t aware|interesting)\b"),
    ("context", r"(?i)\b(credential|api.?key|endpoint|connection.?string|host(name)?:|port:|url:|stored at|located at|config\.toml|\.env\b)\b"),
)
# File extensions that become tags.
TAG_EXTENSIONS = ("py", "ts", "js", "rs", "go", "md", "toml", "yaml", "yml", "json")


def tokens(text) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def content_hash(text) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def wiki_links(text) -> Column:
    """Distinct link targets; the alias is dropped and links to an anchor don't match."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)))


def link_density(content) -> Column:
    """Share of the characters that are link markup, 0 for an empty text."""
    chars = F.aggregate(F.regexp_extract_all(content, F.lit(ANY_LINK), F.lit(0)), F.lit(0), lambda s, x: s + F.length(x))
    return F.when(F.length(content) > 0, chars / F.length(content)).otherwise(0.0)


def is_link_section(heading, content, threshold: float = 0.5, floor: float = 0.1) -> Column:
    """Dense in links under any heading, or somewhat so under a heading that names a list of links."""
    leaf = F.lower(F.trim(F.regexp_replace(F.element_at(F.split(heading, ">"), -1), r"^[# ]+", "")))
    named = F.coalesce(leaf.rlike("^(" + "|".join(LINK_HEADINGS) + ")"), F.lit(False))
    d = link_density(content)
    return (d >= threshold) | ((d >= floor) & named)


def snippet(content, size: int = 300) -> Column:
    return F.when(F.length(content) > size, F.concat(F.substring(content, 1, size), F.lit("..."))).otherwise(content)


def first_sentence(text, most: int = 200) -> Column:
    """One line: the first sentence of 20 to `most` characters, else the beginning."""
    flat = F.regexp_replace(F.btrim(text, F.lit(" \t\r\n")), r"[ \t\r\n]+", " ")
    hit = F.regexp_extract(flat, r"^(.{20,}?[.!?])[ ]", 1)
    cut = F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)
    return F.when((F.length(hit) > 0) & (F.length(hit) <= most), hit).otherwise(cut)


def classify(text, role) -> Column:
    """The first class whose pattern occurs in a text of 40 characters or more; a user's correction is a convention."""
    out = F.when(F.length(text) < 40, F.lit(None)).when((role == "user") & text.rlike(CORRECTION), "convention")
    for name, pattern in CLASSES:
        out = out.when(text.rlike(pattern), name)
    return out


def path_tags(text) -> Column:
    """Up to 5 tags from file paths in a text: known extensions and parent folders, sorted."""
    paths = F.regexp_extract_all(text, F.lit(r"[\w/.-]+\.\w{1,10}"), F.lit(0))
    ext = F.filter(F.transform(paths, lambda p: F.lower(F.element_at(F.split(p, r"\."), -1))), lambda e: e.isin(*TAG_EXTENSIONS))
    deep = F.filter(F.transform(paths, lambda p: F.split(p, "/")), lambda x: F.size(x) > 1)
    parent = F.transform(deep, lambda x: F.when(F.element_at(x, -2) != "", F.element_at(x, -2)).otherwise(F.element_at(x, 1)))
    return F.slice(F.array_sort(F.array_distinct(F.concat(ext, parent))), 1, 5)


def ancestors(path) -> Column:
    """The folders above a path, from the nearest to the top."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def unsafe_path(path) -> Column:
    """Absolute, with an empty, hidden or parent segment, or not a Markdown file."""
    return F.exists(F.split(path, "/"), lambda s: s.rlike(r"^\.|^$")) | ~path.endswith(".md")


def token_estimate(length) -> Column:
    """Four characters a token, rounded down."""
    return F.floor(length / 4)


# Python, over Arrow batches

_CHUNK_SCHEMA = T.ArrayType(T.StructType([T.StructField("heading_path", T.StringType()), T.StructField("content", T.StringType()), T.StructField("position", T.IntegerType())]))


def heading_sections(body: str) -> list[tuple[str, str]]:
    """(heading path, text) of each section, in order; text before the first heading is '(intro)'."""
    import re

    trail: list[tuple[int, str]] = []
    out: list[tuple[str, list[str]]] = [("(intro)", [])]
    for line in body.split("\n"):
        m = re.match(r"(#{1,6})\s+(.+)$", line)
        if m:
            depth = len(m[1])
            trail = [h for h in trail if h[0] < depth] + [(depth, m[2].strip())]
            out.append((" > ".join("#" * d + " " + name for d, name in trail), []))
        out[-1][1].append(line)
    return [(path, text) for path, lines in out if (text := "\n".join(lines).strip())]


def split_note(text: str, limit: int = MAX_CHUNK) -> list[tuple[str, str, int]]:
    """Chunks of a note without its front matter: sections, those over the limit cut hard; positions count on."""
    rows = []
    for path, section in heading_sections(split_frontmatter(text)[1]):
        for at in range(0, len(section), limit):
            piece = section[at : at + limit].strip()
            if piece:
                rows.append((path, piece, len(rows)))
    return rows


def split_frontmatter(text: str) -> tuple[dict, str]:
    """(front matter, rest): a YAML block at the start; one that can't be read counts as empty but is still removed."""
    import re

    m = re.match(r"---\s*\n(.*?)\n---\s*\n", text, re.S)
    if not m:
        return {}, text
    try:
        import yaml

        found = yaml.safe_load(m[1])
    except Exception:
        found = None
    return (found if isinstance(found, dict) else {}), text[m.end() :]


@F.pandas_udf(_CHUNK_SCHEMA)
def heading_chunks(texts: pd.Series) -> pd.Series:
    """Array of (heading_path, content, position) of each note."""
    return texts.map(lambda t: [{"heading_path": h, "content": c, "position": p} for h, c, p in split_note(t)] if t is not None else [])


@F.pandas_udf(T.StringType())
def frontmatter_json(texts: pd.Series) -> pd.Series:
    """The front matter as JSON; dates as text."""
    import json

    return texts.map(lambda t: json.dumps(split_frontmatter(t)[0], default=str, ensure_ascii=False) if t is not None else None)


@F.pandas_udf(T.StringType())
def fold(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Lower case without diacritics."""

    def one(t):
        return None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))

    for s in texts:
        yield s.map(one)


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """English stems of arrays of words (suffix stripping in five steps), each word stemmed once per batch stream."""
    known: dict[str, str] = {}
    for s in words:
        yield s.map(lambda a: None if a is None else [known.get(w) or known.setdefault(w, stem(w)) for w in a])


def _measure(s: str) -> int:
    """Number of vowel-consonant turns."""
    kinds = "".join("v" if _vowel(s, i) else "c" for i in range(len(s)))
    return sum(1 for i in range(1, len(kinds)) if kinds[i - 1] == "v" and kinds[i] == "c")


def _vowel(s: str, i: int) -> bool:
    return s[i] in "aeiou" or (s[i] == "y" and i > 0 and not _vowel(s, i - 1))


def _has_vowel(s: str) -> bool:
    return any(_vowel(s, i) for i in range(len(s)))


def _short(s: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y."""
    n = len(s)
    return n >= 3 and not _vowel(s, n - 1) and _vowel(s, n - 2) and not _vowel(s, n - 3) and s[-1] not in "wxy"


# Suffixes of Porter's algorithm (1980) and what replaces them.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _replace(w: str, table: str) -> str:
    for rule in sorted(table.split(" "), key=lambda r: -len(r.split(":")[0])):
        old, new = rule.split(":")
        if w.endswith(old):
            base = w[: -len(old)]
            return base + new if _measure(base) > 0 else w
    return w


def stem(w: str) -> str:
    """The stem of a lower-case English word; words of other letters are returned as they are."""
    if len(w) <= 2 or not (w.isascii() and w.isalpha()):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        base = w[:-2] if w.endswith("ed") else w[:-3] if w.endswith("ing") else None
        if base is not None and _has_vowel(base):
            if base.endswith(("at", "bl", "iz")):
                w = base + "e"
            elif len(base) > 1 and base[-1] == base[-2] and not _vowel(base, len(base) - 1) and base[-1] not in "lsz":
                w = base[:-1]
            else:
                w = base + "e" if _measure(base) == 1 and _short(base) else base
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, _STEP2), _STEP3)
    for suffix in sorted(_STEP4.split(" "), key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
