"""Readers on files with bad lines, mail, chat logs and pages."""

from __future__ import annotations

import gzip

from pyspark.sql import functions as F

from tallyhall.sources import readers as S
from tallyhall.streaming import activity as A

MAIL = "From a@x Mon\nFrom: Ann <a@x>\nDate: Mon, 5 Feb 2024 10:00:00 +0000\nSubject: Hi\nMessage-ID: <1@x>\n\nbody\n> old\nFrom b@x Tue\nFrom: Bob <b@x>\nDate: Tue, 6 Feb 2024 10:00:00 +0000\nSubject: Re\n\nmore\n"


def test_jsonl_skips_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"n": 1}\n\nnot json\n{"n": 2}\n')
    assert sorted(r.n for r in S.read_jsonl(spark, str(tmp_path / "a.jsonl"), "n int").filter("n IS NOT NULL").collect()) == [1, 2]
    good, bad = S.read_jsonl_counted(spark, str(tmp_path / "a.jsonl"), "n int")
    assert (good.count(), bad.count()) == (2, 1)


def test_mbox(spark, tmp_path):
    (tmp_path / "l.mbox").write_text(MAIL)
    with gzip.open(tmp_path / "l2.txt.gz", "wt") as f:
        f.write(MAIL)
    for name in ("l.mbox", "l2.txt.gz"):
        m = S.read_mbox(spark, str(tmp_path / name))
        got = S.mail_headers(m).orderBy("seq").collect()
        assert [(r["subject"], r["body"].strip()) for r in got] == [("Hi", "body\n> old"), ("Re", "more")]
        parsed = m.orderBy("seq").select(S.parse_mail("message").alias("p")).select("p.*").collect()
        assert parsed[0]["date"] == "2024-02-05T10:00:00+00:00" and parsed[1]["body"].strip() == "more"


def test_chat_lines(spark):
    lines = ["[2012-04-01 10:00:00] <ann> hi", "2012-04-01 10:00:00 <bob> yo", "[10:00:00] <cat> x", "* dan waves", "noise"]
    df = spark.createDataFrame([(x,) for x in lines], "l string").select(S.chat_line(F.col("l"), F.lit("2012-04-01")).alias("c"))
    got = [r.c and (r.c.timestamp, r.c.nickname, r.c.message, r.c.type) for r in df.collect()]
    assert got == [("2012-04-01 10:00:00", "ann", "hi", "message"), ("2012-04-01 10:00:00", "bob", "yo", "message"), ("2012-04-01 10:00:00", "cat", "x", "message"), ("2012-04-01", "dan", "waves", "action"), None]


def test_chat_page(spark):
    html = '<html><div class="log-messages"><div data-timestamp="1"><span class="nick">ann</span><span>hello</span></div><div class="info" data-timestamp="2">joined</div></div></html>'
    r = spark.createDataFrame([(html,)], "h string").select(S.chat_page("h").alias("m")).first().m
    assert [(x.timestamp, x.nickname, x.message) for x in r] == [("1", "ann", "hello")]


def test_proposals_and_sinks(spark, tmp_path):
    d = tmp_path / "p"
    d.mkdir()
    (d / "prop-0042.txt").write_text("Title: A\nAuthor: Ann <a@x>\nStatus: Final\n\ntext")
    r = S.read_proposals(spark, str(d)).first()
    assert (r.number, r.title, r.status) == (42, "A", "Final")
    out = str(tmp_path / "t")
    S.write_records(spark.range(3), out, form="parquet")
    S.append_new(spark.range(5), out, "id")
    assert spark.read.parquet(out).count() == 5


def test_streams(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src)
    d = tmp_path / "in"
    batch.write.parquet(str(d))
    s = A.read_events(spark, str(d), batch.schema)
    q = A.run_to_table(A.counts_per_window(s, "ts", "event_type", late="60 days"), "w", str(tmp_path / "c"))
    q.awaitTermination(60)
    assert spark.table("w").agg(F.sum("n")).first()[0] == batch.count()


def test_lookup_lines_and_sample(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "z"), (2, "a")], "k int, v string")
    assert [r.v for r in S.lookup(df, "k", 2).collect()] == ["a"] and S.lookup(df, "k", 9).count() == 0
    (tmp_path / "x.txt").write_text("1\n2\n3\n")
    assert S.count_lines(spark, str(tmp_path / "x.txt")).first().lines == 3
    S.write_sample(spark.range(100), str(tmp_path / "s"), 10)
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "s")).collect()) == list(range(10))


def test_change_fields(spark):
    schema = "created_at string, merged_at string, closed_at string, comments array<string>, reviews array<string>, files array<struct<additions:long,deletions:long>>"
    df = spark.createDataFrame([("2024-01-01T00:00:00Z", "2024-01-03T12:00:00Z", None, ["a"], None, [(3, 1), (None, 2)]), (None, None, None, None, [], None)], schema)
    a, b = S.change_fields(df).collect()
    assert (a.time_to_merge_days, a.time_to_close_days, a.total_comments, a.total_reviews, a.total_files_changed, a.total_additions, a.total_deletions) == (2, None, 1, 0, 2, 3, 3)
    assert (b.total_comments, b.total_reviews, b.total_files_changed, b.total_additions) == (0, 0, 0, 0)


def test_archive_is_read_whole(spark, tmp_path):
    (tmp_path / "a.txt").write_text("From: x@y\nSubject: s\n\n" + "word " * 40_000 + "https://z.example/p")
    r = S.read_archive(spark, str(tmp_path / "a.txt")).first()
    assert len(r.content) > 200_000 and r["from"] == "x@y" and r.sources == ["https://z.example/p"]
    assert len(S.read_archive(spark, str(tmp_path / "a.txt"), 100).first().content) == 100


def test_versions(spark):
    a = spark.range(10)
    one = S.snapshot(a, "p", "t", "2024-01-01")
    same = S.snapshot(a.repartition(3), "p", "t", "2024-01-02", one)
    two = S.snapshot(spark.range(11), "p", "t", "2024-01-03", one)
    assert same.count() == 1 and [(r.version, r.rows) for r in two.orderBy("version").collect()] == [(1, 10), (2, 11)]


def test_work_goes_on_where_it_stopped(spark, tmp_path):
    seen, path = [], str(tmp_path / "out")

    def work(df):
        seen.append(df.count())
        if len(seen) == 2:
            raise RuntimeError("lost")
        return df.selectExpr("id", "id * 2 AS twice")

    keys = spark.range(25)
    try:
        S.resume(keys, path, "id", work, "id long, twice long", 10)
    except RuntimeError:
        pass
    out = S.resume(keys, path, "id", work, "id long, twice long", 10)
    assert seen == [10, 10, 10, 5] and sorted((r.id, r.twice) for r in out.collect()) == [(k, 2 * k) for k in range(25)]


def test_commit_and_signature_fields(spark):
    df = spark.createDataFrame([("Merge #12: x", ["a", "b"], 'BEGIN PGP SIGNATURE key ID 0123456789ABCDEF Good signature from "Ann <a@x>"'), ("fix #3", ["a"], "none")], "m string, p array<string>, t string")
    a, b = df.select(S.commit_fields(F.col("m"), F.col("p")).alias("c"), S.signature(F.col("t")).alias("s")).collect()
    assert (a.c.is_merge, a.c.merged_number, a.s.is_signed, a.s.key_id, a.s.signer) == (True, 12, True, "0123456789ABCDEF", "Ann <a@x>")
    assert (b.c.is_merge, b.c.merged_number, b.s.is_signed) == (False, None, False)


def test_reports_and_parallel_fetch(spark, tmp_path):
    import json

    S.write_report({"t": spark.createDataFrame([(1, "a")], "n int, v string")}, str(tmp_path / "r"), "name", {"k": "v"}, "2024-01-01")
    body = json.loads(spark.read.text(str(tmp_path / "r")).first().value)
    assert body["data"] == {"t": [{"n": 1, "v": "a"}]} and body["metadata"]["analysis_name"] == "name"
    out = S.fetch_parallel(spark.range(20), lambda k: (int(k), f"v{k}"), "id long, v string")
    assert sorted((r.id, r.v) for r in out.collect()) == [(k, f"v{k}") for k in range(20)]


def test_json_document_and_last_of_a_key(spark, tmp_path):
    from tallyhall.operators import relational as R

    (tmp_path / "d.json").write_text('{\n "people": {"a": 1, "b": 2}\n}')
    assert S.read_json_document(spark, str(tmp_path / "d.json"), "people map<string,int>").first().people == {"a": 1, "b": 2}
    df = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "x")], "k int, line int, v string")
    assert {r.k: r.v for r in R.keep_last(df, "k", "line").collect()} == {1: "new", 2: "x"}


def test_mail_of_an_unknown_charset_keeps_its_text(spark):
    raw = "From: a@x\nDate: Mon, 5 Feb 2024 10:00:00 +0000\nContent-Type: text/plain; charset=x-odd\n\nplain words"
    assert spark.createDataFrame([(raw,)], "m string").select(S.parse_mail("m").alias("p")).first().p.body.strip() == "plain words"
