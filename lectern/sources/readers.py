"""File sources: Markdown notes, transcripts in five shapes, labels; and path lists of changed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import text as x

# Folders that hold no notes.
SKIPPED = (".git", ".obsidian", ".trash")


def markdown_files(spark: SparkSession, root: str, skip: tuple[str, ...] = SKIPPED) -> DataFrame:
    """path (relative), text, modified_at of every .md file below root, hidden tool folders left out."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace(F.col("path"), r"^.*?" + _escape(base.removeprefix("file://")), "")
    out = raw.select(path.alias("path"), F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("modified_at"))
    return out.where(~F.exists(F.split("path", "/"), lambda s: s.isin(*skip)))


def changed_files(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """The notes of an explicit list of changed paths (say, of a version control diff)."""
    full = [f"{root.rstrip('/')}/{p}" for p in paths if p.endswith(".md")]
    if not full:
        return spark.createDataFrame([], "path string, text string, modified_at timestamp")
    raw = spark.read.format("binaryFile").load(full)
    path = F.regexp_replace(F.col("path"), r"^.*?" + _escape(root.rstrip("/").removeprefix("file://") + "/"), "")
    return raw.select(path.alias("path"), F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("modified_at"))


def _escape(s: str) -> str:
    import re

    return re.escape(s)


def parse_notes(files: DataFrame) -> DataFrame:
    """path, title, frontmatter (JSON), content_hash, chunks, links. The title is that of the front matter, else the first H1, else the file's name."""
    fm = x.frontmatter_json("text")
    h1 = F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1)
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.md)?$", 1)
    named = files.withColumn("frontmatter", fm)
    given = F.get_json_object("frontmatter", "$.title")
    title = F.when(F.length(given) > 0, given).when(F.length(h1) > 0, h1).otherwise(stem)
    return named.select("path", title.alias("title"), "frontmatter", x.content_hash(F.col("text")).alias("content_hash"), x.heading_chunks("text").alias("chunks"), x.wiki_links(F.col("text")).alias("links"))


def read_range(files: DataFrame, path: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """path, content, total: a part of one file by characters."""
    one = files.where(F.col("path") == path)
    part = F.substring("text", offset + 1, 2_147_483_647 if limit is None else limit)
    return one.select("path", part.alias("content"), F.length("text").alias("total"))


# Transcripts. Every reader gives session, modified_at, pos, role, text.

_OUT = ["session", "modified_at", "pos", "role", "text"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """session, modified_at, pos, v: the lines of JSON Lines files that can be read, numbered within their file."""
    whole = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select("value", "_metadata.file_name", "_metadata.file_modification_time")
    rows = whole.select(F.regexp_replace("file_name", r"\.[^.]+$", "").alias("session"), F.col("file_modification_time").alias("modified_at"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    return rows.withColumn("v", F.try_parse_json("line")).where("v IS NOT NULL").drop("line")


def _get(v, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _flat(content) -> Column:
    """Text of a message's content: a string, or blocks of text, thinking, tool use and tool results, one a line."""
    def block(b):
        tool = F.concat(F.lit("[tool_use:"), F.coalesce(_get(b, "$.name"), F.lit("")), F.lit("] "), F.coalesce(F.to_json(_get(b, "$.input", "variant")), F.lit("{}")))
        result = F.coalesce(_get(b, "$.text"), F.array_join(F.transform(_get(b, "$.content", "array<variant>"), lambda c: F.coalesce(_get(c, "$.text"), F.lit(""))), " "), _get(b, "$.content"))
        kind = _get(b, "$.type")
        return F.when(kind.isNull(), _get(b, "$")).when(kind == "text", _get(b, "$.text")).when(kind == "thinking", _get(b, "$.thinking")).when(kind == "tool_use", tool).when(kind == "tool_result", result)

    parts = _get(content, "$", "array<variant>")
    return F.when(parts.isNotNull(), F.array_join(F.filter(F.transform(parts, block), lambda t: t.isNotNull()), "\n")).otherwise(_get(content, "$"))


def tool_names(content) -> Column:
    parts = F.filter(_get(content, "$", "array<variant>"), lambda b: _get(b, "$.type") == "tool_use")
    return F.transform(parts, lambda b: _get(b, "$.name"))


def file_paths(text) -> Column:
    """Up to 20 distinct paths (absolute, home or relative) named in a text, sorted."""
    words = F.transform(F.split(text, r"\s+"), lambda w: F.btrim(w, F.lit("\"'`,;:()")))
    return F.slice(F.array_sort(F.array_distinct(F.filter(words, lambda w: w.rlike(r"^(/|~/|\./)")))), 1, 20)


def _kept(df: DataFrame) -> DataFrame:
    return df.where(F.col("role").isin("user", "assistant") & (F.length(F.trim("text")) > 0)).select(*_OUT)


def message_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines with a message of role and content, or a type in place of the role."""
    df = _lines(spark, path)
    return _kept(df.withColumn("role", F.coalesce(_get("v", "$.message.role"), _get("v", "$.type"))).withColumn("text", _flat(_get(F.col("v"), "$.message.content", "variant"))))


def request_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines with a list of requests, each a user message and parts of a response."""
    df = _lines(spark, path).select("session", "modified_at", "pos", F.posexplode_outer(F.coalesce(_get("v", "$.v.requests", "array<variant>"), _get("v", "$.requests", "array<variant>"))).alias("nth", "r"))
    asked = F.array(F.struct(F.lit("user").alias("role"), _get("r", "$.message.text").alias("text")))
    said = F.transform(F.coalesce(_get("r", "$.response.value", "array<variant>"), F.array().cast("array<variant>")), lambda p: F.struct(F.lit("assistant").alias("role"), _get(p, "$.value").alias("text")))
    turns = df.select("session", "modified_at", "pos", "nth", F.posexplode(F.concat(asked, said)).alias("sub", "m"))
    return _kept(turns.select("session", "modified_at", (F.col("pos") * 1_000_000 + F.col("nth") * 1_000 + F.col("sub")).alias("pos"), "m.role", "m.text"))


def payload_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines whose items of type response_item carry a payload of role and content parts."""
    df = _lines(spark, path).where(_get("v", "$.type") == "response_item")
    role = F.coalesce(_get("v", "$.payload.payload.role"), _get("v", "$.payload.role"), _get("v", "$.role"))
    parts = F.coalesce(_get("v", "$.payload.payload.content", "array<variant>"), _get("v", "$.payload.content", "array<variant>"), _get("v", "$.content", "array<variant>"))
    text = F.array_join(F.filter(F.transform(parts, lambda p: _get(p, "$.text")), lambda t: F.length(t) > 0), " ")
    return _kept(df.withColumn("role", role).withColumn("text", text))


def headed_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Markdown in which headings of up to four marks named user or assistant open the turns."""
    whole = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select("value", "_metadata.file_name", "_metadata.file_modification_time")
    parts = F.split(F.concat(F.lit("\n"), "value"), r"(?i)\n(?=#{1,4}[ \t]+(?:user|assistant)[ \t]*\r?(?:\n|$))")
    rows = whole.select(F.regexp_replace("file_name", r"\.[^.]+$", "").alias("session"), F.col("file_modification_time").alias("modified_at"), F.posexplode(parts).alias("pos", "part"))
    head = r"(?i)^#{1,4}[ \t]+(user|assistant)[ \t]*\r?(?:\n|$)"
    return _kept(rows.where("pos > 0").select("session", "modified_at", "pos", F.lower(F.regexp_extract("part", head, 1)).alias("role"), F.rtrim(F.regexp_replace("part", head, ""), F.lit("\n")).alias("text")))


def message_object(spark: SparkSession, path: str, notices: tuple[str, ...] = ("info", "error", "warning")) -> DataFrame:
    """One JSON object a file with a list of messages of type and content; a type other than user and the notices is the assistant's name."""
    whole = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select("value", "_metadata.file_name", "_metadata.file_modification_time")
    msgs = _get(F.try_parse_json("value"), "$.messages", "array<variant>")
    rows = whole.select(F.regexp_replace("file_name", r"\.[^.]+$", "").alias("session"), F.col("file_modification_time").alias("modified_at"), F.posexplode(msgs).alias("pos", "m"))
    kind = _get("m", "$.type")
    parts = F.filter(F.transform(_get("m", "$.content", "array<variant>"), lambda p: F.when(F.coalesce(_get(p, "$.thought", "boolean"), F.lit(False)), F.lit(None)).otherwise(F.coalesce(_get(p, "$.text"), _get(p, "$")))), lambda t: F.length(F.trim(t)) > 0)
    text = F.when(parts.isNotNull(), F.array_join(parts, " ")).otherwise(F.coalesce(_get("m", "$.content.text"), _get("m", "$.content")))
    return _kept(rows.select("session", "modified_at", "pos", F.when(kind == "user", "user").when(~kind.isin(*notices), "assistant").alias("role"), text.alias("text")))


SHAPES = {"message_lines": message_lines, "request_lines": request_lines, "payload_lines": payload_lines, "headed_markdown": headed_markdown, "message_object": message_object}


def recent_sessions(transcripts: DataFrame, n: int = 1) -> DataFrame:
    """The n sessions changed last; union readers by name first."""
    return transcripts.groupBy("session").agg(F.max("modified_at").alias("modified_at")).orderBy(F.desc("modified_at"), "session").limit(n)


def index_transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sessions, messages) of JSON Lines: metadata is the first non-empty by line, last_ts the last by line; messages once per non-empty uuid."""
    v = _lines(spark, path)
    f = {c: _get("v", f"$.{p}") for c, p in (("project", "cwd"), ("slug", "slug"), ("version", "version"), ("at", "timestamp"), ("uuid", "uuid"))}
    rows = v.select("session", "modified_at", "pos", "v", *[c.alias(n) for n, c in f.items()])
    first = lambda c: F.min_by(c, F.when(F.length(c) > 0, F.col("pos"))).alias(c)
    sessions = rows.groupBy("session").agg(first("project"), first("slug"), first("version"), F.min_by("at", F.when(F.length("at") > 0, F.col("pos"))).alias("first_ts"), F.max_by("at", F.when(F.length("at") > 0, F.col("pos"))).alias("last_ts"), F.max("modified_at").alias("file_mtime"))
    body = _get(F.col("v"), "$.message.content", "variant")
    msgs = rows.select("session", "pos", "uuid", F.col("at").alias("timestamp"), F.coalesce(_get("v", "$.message.role"), _get("v", "$.type")).alias("role"), _flat(body).alias("content"), F.array_join(tool_names(body), ",").alias("tool_name"))
    msgs = msgs.where("length(content) > 0").withColumn("file_paths", file_paths(F.col("content")))
    keyed = msgs.withColumn("key", F.when(F.length("uuid") > 0, F.col("uuid")).otherwise(F.concat_ws(":", "session", "pos")))
    once = keyed.groupBy("key").agg(F.min(F.struct("session", "pos", "uuid", "timestamp", "role", "content", "tool_name", "file_paths")).alias("m")).select("m.*")
    return sessions, once


def query_labels(spark: SparkSession, path: str) -> DataFrame:
    """query, targets, category of a YAML list of labelled queries; entries without query or targets are left out."""
    import yaml

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or []
    entries = data.get("queries", []) if isinstance(data, dict) else data
    rows = []
    for e in entries:
        targets = e.get("targets") or e.get("target") or []
        targets = [targets] if isinstance(targets, str) else [str(t) for t in targets]
        if e.get("query") and targets:
            rows.append((str(e["query"]), targets, e.get("category")))
    return spark.createDataFrame(rows, T.StructType([T.StructField("query", T.StringType()), T.StructField("targets", T.ArrayType(T.StringType())), T.StructField("category", T.StringType())]))
