"""Readers of records, mail archives, chat logs, proposals and file lists, and the sinks."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhall.functions import text as X


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One object per line; blank and malformed lines are dropped (SRC1, SRC19-SRC20)."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_jsonl_counted(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines) (SRC1, SRC24)."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    parsed = raw.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").isNull().alias("bad"))
    return parsed.filter(~F.col("bad")).select("r.*"), parsed.filter("bad").select("value")


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def lookup(df: DataFrame, key: str, value, order: list | None = None) -> DataFrame:
    """The first row of a key, none if it is absent (SRC3)."""
    return df.filter(F.col(key) == value).orderBy(*(order or df.columns)).limit(1)


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    """``source, lines`` of text files (SRC24)."""
    return spark.read.text(path).groupBy(F.input_file_name().alias("source")).agg(F.count("*").alias("lines"))


def change_fields(changes: DataFrame) -> DataFrame:
    """Derived columns of extracted changes: whole days to merge and to close, totals of their arrays (SRC19, SRC20)."""
    from tallyhall.functions import dates as D

    days = lambda end: D.whole_days(D.parse(F.col("created_at")), D.parse(F.col(end)))
    n = lambda c: F.coalesce(F.nullif(F.size(c), F.lit(-1)), F.lit(0))
    total = lambda f: F.coalesce(F.aggregate(F.transform("files", lambda x: F.coalesce(x[f], F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))
    return changes.withColumns({"time_to_merge_days": days("merged_at"), "time_to_close_days": days("closed_at"), "total_comments": n("comments"), "total_reviews": n("reviews"), "total_files_changed": n("files"), "total_additions": total("additions"), "total_deletions": total("deletions")})


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """``source, seq, message`` of mail archives, plain or gzip, cut at lines that start with 'From ' (SRC12, SRC13)."""
    whole = spark.read.text(path, wholetext=True).withColumn("source", F.input_file_name())
    return whole.select("source", F.posexplode(F.split("value", r"\n(?=From )")).alias("seq", "message")).filter(F.trim("message") != "")


def mail_headers(messages: DataFrame, column: str = "message") -> DataFrame:
    """Headers by pattern and the body after the first blank line; rows without From or Date go (SRC15)."""
    m = F.col(column)
    out = messages.withColumns({n: X.header(m, h) for n, h in (("from", "From"), ("date", "Date"), ("subject", "Subject"), ("message_id", "Message-ID"), ("in_reply_to", "In-Reply-To"), ("references", "References"))})
    body = F.when(F.instr(m, "\n\n") > 0, F.substring(m, F.instr(m, "\n\n") + 2, F.length(m))).otherwise("")
    return out.withColumn("body", body).filter((F.col("from") != "") & (F.col("date") != ""))


_MAIL = T.StructType([T.StructField(n, T.StringType()) for n in ("from", "date", "subject", "message_id", "in_reply_to", "references", "body")])
_CHAT = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("timestamp", "nickname", "message")]))


@F.pandas_udf(_MAIL)
def parse_mail(messages: pd.Series) -> pd.DataFrame:
    """RFC 822 messages: decoded headers, ISO date, all text/plain parts (SRC14, SRC16)."""
    from email import message_from_string, policy
    from email.utils import parsedate_to_datetime

    rows = []
    for raw in messages:
        m = message_from_string((raw or "").split("\n", 1)[-1] if (raw or "").startswith("From ") else raw or "", policy=policy.default)
        try:
            date = parsedate_to_datetime(m["Date"]).isoformat() if m["Date"] else None
        except (TypeError, ValueError):
            date = None
        parts = []
        for part in m.walk():
            if part.get_content_type() == "text/plain":
                try:
                    parts.append(part.get_content())
                except (LookupError, ValueError):  # a charset that isn't known or doesn't fit
                    parts.append((part.get_payload(decode=True) or b"").decode("utf-8", "replace"))
        rows.append([str(m[h]) if m[h] else None for h in ("From",)] + [date] + [str(m[h]) if m[h] else None for h in ("Subject", "Message-ID", "In-Reply-To", "References")] + ["".join(parts)])
    return pd.DataFrame(rows, columns=["from", "date", "subject", "message_id", "in_reply_to", "references", "body"])


def chat_line(line: Column, default_date: Column | None = None) -> Column:
    """struct(timestamp, nickname, message, type) of a chat log line; null if no grammar fits (SRC9)."""
    stamp, bare, clock, act = r"^\[(\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d)?)\]\s*<([^>]+)>\s?(.*)$", r"^(\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d)?)\s+<([^>]+)>\s?(.*)$", r"^\[(\d\d:\d\d(?::\d\d)?)\]\s*<([^>]+)>\s?(.*)$", r"^\*\s+(\S+)\s+(.*)$"
    day = F.lit(None).cast("string") if default_date is None else default_date

    def by(pattern: str, when: Column) -> Column:
        return F.when(line.rlike(pattern), F.struct(when.alias("timestamp"), F.regexp_extract(line, pattern, 2).alias("nickname"), F.regexp_extract(line, pattern, 3).alias("message"), F.lit("message").alias("type")))

    action = F.when(line.rlike(act), F.struct(day.alias("timestamp"), F.regexp_extract(line, act, 1).alias("nickname"), F.regexp_extract(line, act, 2).alias("message"), F.lit("action").alias("type")))
    return F.coalesce(by(stamp, F.regexp_extract(line, stamp, 1)), by(bare, F.regexp_extract(line, bare, 1)), by(clock, F.concat_ws(" ", day, F.regexp_extract(line, clock, 1))), action)


class _Messages(HTMLParser):
    """Message blocks of a chat page: elements with a data-timestamp, their nick and text."""

    def __init__(self) -> None:
        super().__init__()
        self.rows, self.now, self.nick, self.depth = [], None, False, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        kinds = (a.get("class") or "").split()
        if self.now is None and "data-timestamp" in a and not {"info", "op-topic"} & set(kinds):
            self.now, self.depth = {"timestamp": a["data-timestamp"], "nickname": "", "message": ""}, 0
        if self.now is not None:
            self.depth += tag not in ("br", "img", "hr", "input", "meta", "link")
            self.nick = any("nick" in k for k in kinds)

    def handle_endtag(self, tag: str) -> None:
        if self.now is not None:
            self.nick = False
            self.depth -= 1
            if self.depth <= 0:
                self.rows.append(self.now)
                self.now = None

    def handle_data(self, data: str) -> None:
        if self.now is not None:
            self.now["nickname" if self.nick else "message"] += data


@F.pandas_udf(_CHAT)
def chat_page(pages: pd.Series) -> pd.Series:
    """Messages of HTML chat pages."""
    out = []
    for html in pages:
        p = _Messages()
        p.feed(html or "")
        out.append([{k: v.strip() for k, v in r.items()} for r in p.rows])
    return pd.Series(out)


def is_html(content: Column) -> Column:
    low = F.lower(content)
    return low.contains("<html") | low.contains("<body")


def read_proposals(spark: SparkSession, path: str) -> DataFrame:
    """Header fields of proposal files; the number comes from the file name (SRC17, STR14)."""
    f = spark.read.text(path, wholetext=True).withColumn("filename", F.element_at(F.split(F.input_file_name(), "/"), -1))
    c = F.col("value")
    fields = {n.lower(): X.header(c, n) for n in ("Title", "Author", "Status", "Type", "Created")}
    return f.withColumns({"number": F.regexp_extract("filename", r"(\d+)", 1).try_cast("int"), **fields, "content_length": F.length(c)}).filter(F.col("number").isNotNull()).withColumnRenamed("value", "content")


def read_archive(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Archive texts: whole content (or up to ``limit`` characters), digest, optional mail headers and the first ten addresses (SRC18)."""
    f = spark.read.format("binaryFile").load(path)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    text = text if limit is None else F.substring(text, 1, limit)
    return f.select("path", F.sha2("content", 256).alias("sha256"), text.alias("content")).withColumns({"from": X.header(F.col("content"), "From"), "subject": X.header(F.col("content"), "Subject"), "date": X.header(F.col("content"), "Date"), "sources": F.slice(F.regexp_extract_all("content", F.lit(r"(https?://[^\s)>\"']+)"), 1), 1, 10)})


def signature(tag_text: Column) -> Column:
    """struct(is_signed, key_id, signer) of a tag's text and verification output (SRC22, SRC23)."""
    return F.struct(tag_text.contains("BEGIN PGP SIGNATURE").alias("is_signed"), F.regexp_extract(tag_text, r"(?i)key (?:ID )?([0-9A-F]{8,40})", 1).alias("key_id"), F.regexp_extract(tag_text, r'Good signature from "([^"]+)"', 1).alias("signer"))


def commit_fields(message: Column, parents: Column) -> Column:
    """struct(is_merge, merged_number) of a commit (SRC21)."""
    merge = F.size(parents) > 1
    number = F.regexp_extract(message, r"#(\d+)", 1).try_cast("long")
    return F.struct(merge.alias("is_merge"), F.when(merge, number).alias("merged_number"))


def maintainer_line(line: Column) -> Column:
    """struct(name, email, user) of 'Name <mail> (user)' (SRC34, SRC35)."""
    return F.struct(F.trim(F.regexp_extract(line, r"^[\s*-]*([^<(]+)", 1)).alias("name"), F.regexp_extract(line, r"<([^>]+)>", 1).alias("email"), F.regexp_extract(line, r"\(@?([\w-]+)\)", 1).alias("user"))


def fetch_parallel(keys: DataFrame, fetch, schema: str, workers: int = 5) -> DataFrame:
    """Call ``fetch(key) -> row tuple`` for every key, spread over tasks (SRC31, SRC32)."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([fetch(k) for k in b.iloc[:, 0]], columns=names)

    return keys.repartition(workers).mapInPandas(run, schema)


def write_records(df: DataFrame, path: str, mode: str = "overwrite", form: str = "json") -> None:
    df.write.mode(mode).format(form).save(path)


def write_sample(df: DataFrame, path: str, n: int = 10, order: list | None = None, form: str = "json") -> None:
    """The first ``n`` rows of a table, in an order, as a small file (SRC25)."""
    df.orderBy(*(order or df.columns)).limit(n).coalesce(1).write.mode("overwrite").format(form).save(path)


def snapshot(df: DataFrame, path: str, name: str, as_of: str, versions: DataFrame | None = None) -> DataFrame:
    """A version record of a table: digest over all rows, number of rows and version (DQ11).

    The digest is a sum of row hashes, so it doesn't depend on order or files; a
    table whose digest is the last one's gets no new version.
    """
    spark = df.sparkSession
    row = F.xxhash64(*df.columns).cast("decimal(38,0)")
    now = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest")).first()
    known = versions.filter(F.col("name") == name).orderBy(F.desc("version")).limit(1).collect() if versions is not None else []
    if known and known[0].digest == now.digest:
        return versions
    record = spark.createDataFrame([(name, (known[0].version if known else 0) + 1, now.rows, now.digest, path, as_of)], "name string, version int, rows long, digest string, path string, as_of string")
    return record if versions is None else versions.unionByName(record)


def resume(keys: DataFrame, path: str, key: str, work, schema: str, batch: int = 1000) -> DataFrame:
    """Work on every key once, in batches whose results are kept: a run that stops goes on where it was (DQ12).

    ``work`` maps a table of keys to a table of ``schema``. Each batch is
    appended to ``path`` as a whole; keys found there are skipped.
    """
    spark = keys.sparkSession

    def done() -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], schema)

    while True:
        left = keys.select(key).distinct().join(done().select(key).distinct(), key, "left_anti").orderBy(key).limit(batch).collect()  # at most a batch
        if not left:
            return done()
        work(spark.createDataFrame(left, keys.select(key).schema)).write.mode("append").parquet(path)


def append_new(df: DataFrame, path: str, key: str, form: str = "parquet") -> None:
    """Append rows whose key isn't stored yet (SRC27)."""
    stored = df.sparkSession.read.format(form).load(path)
    df.join(stored.select(key).distinct(), key, "left_anti").write.mode("append").format(form).save(path)


def write_report(tables: dict[str, DataFrame], path: str, name: str, parameters: dict[str, str], as_of: str) -> None:
    """One JSON report; its tables are small results of aggregates, joined as JSON by Spark (SRC28, DQ14)."""
    spark = next(iter(tables.values())).sparkSession
    parts = [df.agg(F.lit(k).alias("k"), F.to_json(F.collect_list(F.struct(*df.columns))).alias("v")) for k, df in tables.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    data = {r.k: r.v for r in every.collect()}
    import json

    body = json.dumps({"metadata": {"analysis_name": name, "timestamp": as_of, "version": "1.0", "parameters": parameters}, "data": {k: json.loads(v) for k, v in data.items()}})
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges as rows of JSON for a chart sink (SRC29, SRC30)."""
    return nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*nodes.columns)).alias("json")).unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(*edges.columns)).alias("json")))
