"""What people say and do across platforms: states of mind, users, mentions, answers, releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhall.functions import keywords as K
from tallyhall.functions import text as T


def spoken(changes: DataFrame, reviews: DataFrame, comments: DataFrame, issues: DataFrame) -> DataFrame:
    """``actor, kind, k, j, t``: every text by its author, in an order; j > 0 belongs to the row before it."""
    stance = F.when(F.lower("state") == "approved", " ack approve support").when(F.lower("state") == "changes_requested", " nack oppose concern").otherwise("")

    def part(df: DataFrame, kind: int, k: str, j: int, t: Column) -> DataFrame:
        return df.select(F.lower("author").alias("actor"), F.lit(kind).alias("kind"), F.col(k).alias("k"), F.lit(j).alias("j"), T.or_empty(t).alias("t"))

    out = part(changes, 1, "number", 0, F.col("title")).unionByName(part(changes, 1, "number", 1, F.col("body"))).unionByName(part(reviews, 2, "seq", 0, F.concat("body", stance))).unionByName(part(comments, 3, "seq", 0, F.col("body")))
    return out.unionByName(part(issues, 4, "number", 0, F.col("title"))).unionByName(part(issues, 4, "number", 1, F.col("body"))).filter("actor <> ''")


def actor_states(texts: DataFrame) -> DataFrame:
    """State of mind of every actor over all texts joined by spaces, by priority of the classes.

    The texts are never joined: a word that is in any of them is in the whole,
    and a phrase over a border is looked for in what is left of the texts
    before it (as far as a phrase reaches) and the next text's start.
    """
    kinds = ("som1", "som2", "som5", "som6")
    every = [(k, w) for k in kinds for w in K.STATE_OF_MIND[k]]
    reach = max(len(w) for _, w in every) - 1
    order = Window.partitionBy("actor").orderBy("kind", "k", "j").rowsBetween(-reach, -1)
    # At most ``reach`` texts can share a phrase, as each adds at least a space.
    tails = F.collect_list(F.substring("t", -reach, reach)).over(order)
    edge = F.concat_ws(" ", F.substring(F.concat_ws(" ", "_before"), -reach, reach), F.substring("t", 1, reach))
    b = texts.withColumn("_before", tails).select("actor", "j", F.lower(F.concat_ws("\u0000", "t", edge)).alias("_b"))
    found = b.groupBy("actor").agg(F.count_if(F.col("j") == 0).alias("activities"), *[F.max(F.col("_b").contains(w).cast("int")).alias(f"_{i}") for i, (_, w) in enumerate(every)])
    score = {k: sum((F.col(f"_{i}") for i, (x, _) in enumerate(every) if x == k), F.lit(0)) for k in kinds}
    s = found.select("actor", "activities", *[c.alias(k) for k, c in score.items()])
    n, one, two, five, six = (F.col(c) for c in ("activities", *kinds))
    first = (one > 0) | ((n >= 5) & (two >= 3))
    som = F.when(six > 0, "som6").when(first, "som1").when(five > 0, "som5").when((two > 0) | (n >= 3), "som2").when(n >= 1, "som3").otherwise("som4")
    sure = F.when(six > 0, F.when(six >= 2, "high").otherwise("medium")).when(first, F.when((one >= 2) | (n >= 10), "high").otherwise("medium")).when((five > 0) | (two > 0) | (n >= 3), "medium").otherwise("low")
    return s.withColumns({"som": som, "confidence": sure})


def platform_users(changes: DataFrame, issues: DataFrame, reviews: DataFrame, comments: DataFrame, mails: DataFrame, chat: DataFrame, signers: DataFrame) -> DataFrame:
    """``platform, id, items, more, first_seen`` of every user of each platform."""
    none, text = F.lit(None).cast("long"), F.lit(None).cast("string")

    def one(df: DataFrame, platform: str, who: Column, item: Column, more: Column, seen: Column) -> DataFrame:
        return df.select(F.lit(platform).alias("platform"), who.alias("id"), item.isNotNull().cast("int").alias("i"), more.isNotNull().cast("int").alias("m"), seen.alias("s"))

    inside = F.regexp_extract("sender", r"<([^>]+)>", 1)
    address = F.when(F.col("sender").contains("<"), inside).otherwise(F.trim("sender"))
    author = F.col("author")
    every = one(changes, "forge", author, F.col("number"), none, F.col("created")).unionByName(one(issues, "forge", author, none, F.col("number"), F.col("created")))
    for answers in (reviews, comments):
        every = every.unionByName(one(answers, "forge", author, none, none, text))
    every = every.unionByName(one(mails, "mail", address, F.col("message_id"), none, F.col("date")).filter(F.col("id").contains("@")))
    every = every.unionByName(one(chat, "chat", F.col("nickname"), F.lit(1), none, F.col("ts"))).unionByName(one(signers.filter("is_signed"), "signing", F.col("signer_email"), F.col("tag"), none, F.col("date")))
    return every.filter("id <> ''").groupBy("platform", "id").agg(F.sum("i").alias("items"), F.sum("m").alias("more"), F.min("s").alias("first_seen"))


def overlap_improvement(forge: DataFrame, chat: DataFrame, aliases: DataFrame) -> DataFrame:
    """Users on both platforms by equal names, and with the aliases of known people (unified, platform, id)."""
    names = forge.select(F.lower(forge.columns[0]).alias("u"), F.lit(1).alias("g"), F.lit(0).alias("c")).unionByName(chat.select(F.lower(chat.columns[0]).alias("u"), F.lit(0).alias("g"), F.lit(1).alias("c"))).filter("u <> ''")
    on = names.groupBy("u").agg(F.max("g").alias("g"), F.max("c").alias("c"))
    known = aliases.select("unified", "platform", F.lower("id").alias("u")).join(on, "u", "left")
    is_forge = F.col("platform") == "forge"
    p = known.groupBy("unified").agg(F.max(F.when(is_forge, F.col("g"))).alias("f"), F.max(F.when(F.col("platform") == "chat", F.col("c"))).alias("h"), F.max(F.when(is_forge, F.col("c"))).alias("counted"))
    more = p.agg(F.count_if((F.col("f") == 1) & (F.col("h") == 1) & (F.coalesce("counted", F.lit(0)) == 0)).alias("improvement"))
    base = on.agg(F.count_if((F.col("g") == 1) & (F.col("c") == 1)).alias("original"), F.sum("g").alias("forge_users"), F.sum("c").alias("chat_users"))
    both = base.select("original", "forge_users", "chat_users", F.lit(0).alias("improvement")).unionByName(more.select(F.lit(0).alias("original"), F.lit(0).alias("forge_users"), F.lit(0).alias("chat_users"), "improvement"))
    s = both.agg(*[F.sum(c).alias(c) for c in both.columns])
    return s.select("original", (F.col("original") + F.col("improvement")).alias("improved"), "improvement", "forge_users", "chat_users")


def mentioned(messages: DataFrame, text: Column, actor: str, changes: DataFrame) -> DataFrame:
    """``number, messages, actors, merged`` of the changes that messages mention (once each)."""
    e = messages.select(F.col(actor).alias("actor"), F.explode(F.array_distinct(T.change_mentions(text))).alias("number"))
    return e.join(changes.select("number", "merged"), "number").groupBy("number").agg(F.count("*").alias("messages"), F.countDistinct(F.lower("actor")).alias("actors"), F.bool_or("merged").alias("merged"))


def answers(changes: DataFrame, comments: DataFrame, reviews: DataFrame) -> DataFrame:
    """``number, author, created, t``: every text said on a change, with whom it answers."""
    said = comments.select("number", F.col("body").alias("t")).unionByName(reviews.select("number", F.col("body").alias("t")))
    return said.join(changes.select("number", "author", "created"), "number")


def release_parts(releases: DataFrame, commits: DataFrame, changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``tag, number, title, merged``: changes named by the merge commits since the release before.

    Releases and commits are put in one order of time, so each commit finds the
    next release by one window instead of a range join; ``by`` names columns of
    both (a repository) within which that order holds.
    """
    own = by or []
    number = F.coalesce(F.nullif(F.regexp_extract("message", r"Merge (?:pull request )?#(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract("message", r"#(\d+)", 1), F.lit(""))).cast("long")
    tags = releases.filter("tag IS NOT NULL").select(*own, "date", F.lit(1).alias("o"), "tag", F.lit(None).cast("long").alias("number"))
    parts = commits.filter("parents > 1 AND sha <> ''").select(*own, "date", F.lit(0).alias("o"), F.lit(None).cast("string").alias("tag"), number.alias("number"))
    upcoming = Window.partitionBy(*own).orderBy("date", "o", "tag").rowsBetween(0, Window.unboundedFollowing)
    named = tags.unionByName(parts).withColumn("tag", F.first("tag", ignorenulls=True).over(upcoming)).filter("number IS NOT NULL AND tag IS NOT NULL").select(*own, "tag", "number").distinct()
    return named.join(changes.select(*own, "number", F.substring("title", 1, 100).alias("title"), "merged"), [*own, "number"], "left").select(*own, "tag", "number", "title", "merged")


def roster(lines: DataFrame, line: str = "line", value: str = "value") -> DataFrame:
    """``category, username, email`` of a list of maintainers; a header holds for the lines after it.

    Lines that are all capitals or have no colon are headers; blank lines and
    those that start with # say nothing; a person has a mail address or a user.
    """
    v = F.trim(value)
    header = ((F.upper(v) == v) & (F.lower(v) != v)) | ~v.contains(":")
    kept = lines.filter((v != "") & ~v.startswith("#")).withColumn("_head", F.when(header, v))
    carried = F.last("_head", ignorenulls=True).over(Window.orderBy(line).rowsBetween(Window.unboundedPreceding, 0))
    people = kept.withColumn("category", carried).filter(F.col("_head").isNull() & F.col(value).contains("@"))
    user, mail = F.lower(F.regexp_extract(v, r"\(@([\w-]+)\)", 1)), F.regexp_extract(v, "<([^>]+)>", 1)
    return people.select("category", F.nullif(user, F.lit("")).alias("username"), F.nullif(mail, F.lit("")).alias("email"))
