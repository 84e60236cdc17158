"""Rule-based classes and scores of changes, reviews and messages, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhall.functions import keywords as K
from tallyhall.functions import text as T
from tallyhall.functions.numbers import ratio


def _text(title: Column, body: Column) -> Column:
    return F.lower(F.concat_ws(" ", T.or_empty(title), T.or_empty(body)))


def importance(title: Column, body: Column, labels: Column, changes: Column, file_names: Column) -> Column:
    """trivial, low, normal, high or critical; the critical signs are asked first."""
    text, labels = _text(title, body), F.transform(F.coalesce(labels, F.array().cast("array<string>")), F.lower)
    n, files = F.coalesce(changes, F.lit(0)), F.coalesce(file_names, F.array().cast("array<string>"))

    def labelled(*parts: str) -> Column:
        return F.exists(labels, lambda x: T.contains_any(x, list(parts)))

    def is_doc(f: Column) -> Column:
        return f.rlike(r"\.(md|txt|rst|tex)$")

    def is_test(f: Column) -> Column:
        return F.lower(f).contains("test")

    def is_code(f: Column) -> Column:
        return f.rlike(r"\.(h|cpp|c)$") & ~is_test(f)

    only_docs = F.exists(files, is_doc) & ~F.exists(files, lambda f: ~is_doc(f) & (is_test(f) | is_code(f)))
    touches = F.exists(files, lambda f: is_code(f) & T.contains_any(F.lower(f), ["consensus", "validation", "script", "policy"]))
    critical = T.contains_any(text, K.CRITICAL) | labelled("consensus", "security", "critical") | (n > 1000)
    housekeeping = T.contains_any(text, K.HOUSEKEEPING) | labelled("doc", "test", "trivial") | only_docs
    return (
        F.when(critical, "critical")
        .when(housekeeping & (n < 10), "trivial")
        .when(housekeeping, "low")
        .when(touches & (n > 100), "critical")
        .when(touches, "high")
        .when(n < 5, "trivial")
        .when(n >= 500, "high")
        .when(n < 50, "low")
        .when(n >= 200, "high")
        .otherwise("normal")
    )


def importance_variant(title: Column, body: Column, changes: Column) -> Column:
    """Importance by words and size alone, without the rule for core files; bands at 5, 10, 200 and 1000."""
    n = F.coalesce(changes, F.lit(0))

    def told(b: Column) -> Column:
        critical, housekeeping = T.contains_any(b, K.CRITICAL) | (n > 1000), T.contains_any(b, K.HOUSEKEEPING)
        return F.when(critical, "critical").when(housekeeping & (n < 10), "trivial").when(housekeeping, "low").when(n >= 200, "high").when(n < 5, "trivial").otherwise("normal")

    return T.lowered(F.concat_ws(" ", T.or_empty(title), T.or_empty(body)), told)


def importance_by_size(changes: Column) -> Column:
    n = F.coalesce(changes, F.lit(0))
    return F.when(n < 10, "trivial").when(n < 50, "low").when(n < 200, "normal").when(n < 500, "high").otherwise("critical")


def change_type(title: Column, body: Column, labels: Column) -> Column:
    """struct(primary_type, subtypes, consensus_related, confidence)."""
    text, labels = _text(title, body), F.transform(F.coalesce(labels, F.array().cast("array<string>")), F.lower)
    consensus = T.contains_any(text, K.CONSENSUS_RELATED)
    is_type = {name: T.contains_any(text, ks) | F.array_contains(labels, label) for name, (ks, label, _) in K.CHANGE_TYPES.items()}
    primary, confidence = F.when(consensus, "consensus"), F.when(consensus, "medium")
    for name, (_, _, sure) in K.CHANGE_TYPES.items():
        primary, confidence = primary.when(is_type[name], name), confidence.when(is_type[name], sure)
    subtypes = [F.when(c, F.lit(name)) for name, c in is_type.items()] + [F.when(T.contains_any(text, K.PERFORMANCE), F.lit("performance"))]
    return F.struct(primary.otherwise("unknown").alias("primary_type"), F.array_compact(F.array(*subtypes)).alias("subtypes"), consensus.alias("consensus_related"), confidence.otherwise("low").alias("confidence"))


def issue_type(title: Column, body: Column, labels: Column) -> Column:
    """bug, feature or question; a later rule overrides an earlier one."""
    text, labels = _text(title, body), F.transform(F.coalesce(labels, F.array().cast("array<string>")), F.lower)
    return (
        F.when(F.array_contains(labels, "question") | T.contains_any(text, ["question", "how to", "help"]), "question")
        .when(F.array_contains(labels, "feature") | T.contains_any(text, ["feature", "request", "enhancement"]), "feature")
        .when(F.array_contains(labels, "bug") | T.contains_any(text, ["bug", "crash", "error"]), "bug")
        .otherwise("unknown")
    )


def review_class(state: Column, body: Column) -> Column:
    """struct(review_type, sentiment, strength, is_nack, body_length)."""
    s, b = F.lower(T.or_empty(state)), F.lower(T.or_empty(body))
    kind = F.when(s.isin("approved", "approve"), "approval").when(s.isin("changes_requested", "request_changes"), "request_changes").when(s == "dismissed", "dismissal").otherwise("comment")
    mood = F.when(T.contains_any(b, K.REVIEW_POSITIVE), "positive").when(T.contains_any(b, K.REVIEW_NEGATIVE), "negative").otherwise("neutral")
    n = F.length(b)
    strength = F.when((n > 200) | T.contains_any(b, K.REVIEW_STRONG), "strong").when(n < 50, "weak").otherwise("medium")
    return F.struct(kind.alias("review_type"), mood.alias("sentiment"), strength.alias("strength"), b.contains("nack").alias("is_nack"), n.alias("body_length"))


def formal_score(state: Column, body: Column, long: int = 50, short: int = 10) -> Column:
    """Score of a formal review by its state and the length of its text."""
    n = F.length(F.trim(T.or_empty(body)))
    decisive = F.upper(T.or_empty(state)).isin("APPROVED", "CHANGES_REQUESTED")
    return F.when(~decisive, F.when(n > 0, 0.5).otherwise(0.3)).when(n > long, 1.0).when(n > short, 0.8).when(n > 0, 0.7).otherwise(0.5)


def ack_score(body: Column, long: int = 100, short: int = 20) -> Column:
    b = F.trim(T.or_empty(body))
    n = F.length(b)
    return F.when(n > long, 0.5).when(n > short, 0.4).when(b.rlike(T.HASH), 0.3).otherwise(0.2)


def is_ack(body: Column) -> Column:
    return T.or_empty(body).rlike(T.ACK)


def quality_category(score: Column) -> Column:
    return F.when(score == 0, "none").when(score < 0.3, "minimal").when(score < 0.5, "low").when(score < 1.0, "medium").when(score < 2.0, "high").otherwise("very_high")


def quality_class(score: Column) -> Column:
    return F.when(score < 0.3, "none").when(score < 0.5, "low").when(score < 0.8, "medium").otherwise("high")


def zero_review_threshold(created: Column) -> Column:
    """0.3 before formal reviews counted, 0.5 from then on."""
    return F.when(created < F.lit(K.FORMAL_REVIEWS_FROM).cast("timestamp_ntz"), 0.3).otherwise(0.5)


def has_meaningful_review(score: Column, created: Column | None = None, least: float = 0.5) -> Column:
    return score >= (F.lit(least) if created is None else zero_review_threshold(created))


def review_depth(body: Column, inline: Column) -> Column:
    """struct of the eight depth features of a review."""
    b = F.trim(T.or_empty(body))
    refs, asks, suggests = F.regexp_count(b, F.lit(T.CODE_REFS)), T.count_of(b, "?"), T.hits(F.lower(b), K.SUGGESTION)
    return F.struct(
        F.size(inline).alias("inline_comments"), F.length(b).alias("body_length"), T.word_count(b).alias("word_count"), refs.alias("code_references"),
        asks.alias("question_count"), suggests.alias("suggestion_count"), (refs > 0).alias("has_code_reference"), (asks > 0).alias("has_question"), (suggests > 0).alias("has_suggestion"),
    )


def topics(body: Column) -> Column:
    return T.lowered(body, lambda b: T.matching(b, K.TOPICS))


def themes(body: Column) -> Column:
    return T.lowered(body, lambda b: T.matching(b, K.THEMES))


def is_rubber_stamp(state: Column, body: Column) -> Column:
    b = F.lower(F.trim(T.or_empty(body)))
    stock = T.contains_any(b, ["lgtm", "looks good", "ack", "approved", "+1"])
    return (F.upper(T.or_empty(state)) == "APPROVED") & ((F.length(b) < 10) | (stock & (F.length(b) < 50)))


def toxicity_score(body: Column) -> Column:
    return T.lowered(body, lambda b: T.hits(b, K.NEGATIVE) + T.hits(b, K.HARSH) - T.hits(b, K.POLITE))


def channel_sentiment(body: Column) -> Column:
    lead = T.lowered(body, lambda b: T.hits(b, K.CHANNEL_POSITIVE) - T.hits(b, K.CHANNEL_NEGATIVE))
    return T.let(lead, lambda n: F.when(n > 0, "positive").when(n < 0, "negative").otherwise("neutral"))


def state_of_mind(body: Column) -> Column:
    """The class with most hits, the first of equals; null without any."""
    names = F.array(*[F.lit(k) for k in K.STATE_OF_MIND])
    scores = T.lowered(body, lambda b: F.array(*[T.hits(b, ks) for ks in K.STATE_OF_MIND.values()]))
    return T.let(scores, lambda s: F.when(F.array_max(s) > 0, F.get(names, (F.array_position(s, F.array_max(s)) - 1).cast("int"))))


def shift_type(before: Column, after: Column) -> Column:
    order = F.array(*[F.lit(x) for x in ("som6", "som5", "som4", "som3", "som2", "som1")])
    a, b = F.array_position(order, before), F.array_position(order, after)
    return F.when(b > a, "more_supportive").when(b < a, "less_supportive").otherwise("no_change")


def pressure(body: Column) -> Column:
    """struct(has_pressure, types, groups, score): groups of outside pressure with a hit.

    Each keyword is looked for once; groups, types and score follow from the groups' hits.
    """
    named = {f"{kind}_{g}": ks for kind, groups in K.PRESSURE.items() for g, ks in groups.items()}
    at = {name: k for k, name in enumerate(named)}

    def told(n: Column) -> Column:
        groups = F.array_compact(F.array(*[F.when(n[k] > 0, F.lit(name)) for name, k in at.items()]))
        score = F.aggregate(n, F.lit(0), lambda s, x: s + x)
        types = F.array_compact(F.array(*[F.when(F.greatest(*[n[at[f"{kind}_{g}"]] for g in gs]) > 0, F.lit(kind)) for kind, gs in K.PRESSURE.items()]))
        return F.struct((score > 0).alias("has_pressure"), types.alias("types"), groups.alias("groups"), score.alias("score"))

    return T.let(T.lowered(body, lambda b: F.array(*[T.hits(b, ks) for ks in named.values()])), told)


def funding_types(body: Column) -> Column:
    b = F.lower(T.or_empty(body))
    return F.array_compact(F.array(*[F.when(b.rlike(p), F.lit(k)) for k, p in K.FUNDING.items()]))


def funding_sources(body: Column, sources: list[str]) -> Column:
    """Which of the caller's organisations a text names."""
    b = F.lower(T.or_empty(body))
    return F.filter(F.array(*[F.lit(s) for s in sources]), lambda s: b.contains(s))


def funding_amounts(body: Column) -> Column:
    return F.regexp_extract_all(T.or_empty(body), F.lit(r"(\$\s?\d[\d,.]*\s?(?:[kKmM]|million|thousand)?)"), 1)


def rejected(state: Column, merged: Column) -> Column:
    return F.coalesce((state == "closed") & ~merged, F.lit(False))


def rejection_reasons(text: Column) -> Column:
    return T.lowered(text, lambda b: T.matching(b, K.REJECTION))


def contribution_quality(changes: Column, files: Column, body: Column, reviews: Column, comments: Column, merged: Column) -> Column:
    """Additive score of a contribution, at most 1."""
    def part(c: Column, v: float) -> Column:
        return F.when(c, v).otherwise(0.0)

    return F.least(F.lit(1.0), part(merged, 0.3) + part(changes > 10, 0.2) + part(changes > 100, 0.1) + part(F.length(T.or_empty(body)) > 100, 0.2) + part(reviews > 0, 0.1) + part(files > 1, 0.05) + part(comments > 0, 0.05))


def complexity(changes: Column, files: Column) -> Column:
    return F.when((changes < 50) & (files <= 2), "simple").when((changes < 500) & (files <= 10), "medium").otherwise("complex")


def domain(file_name: Column) -> Column:
    """The first domain with a keyword in the file name, null if none."""
    low, out = F.lower(file_name), None
    for name, ks in K.DOMAINS.items():
        c = T.contains_any(low, ks)
        out = F.when(c, name) if out is None else out.when(c, name)
    return out


def nack_type(body: Column) -> Column:
    b = F.lower(T.or_empty(body))
    return F.when(b.contains("concept nack"), "concept").when(b.contains("approach nack"), "approach").when(b.contains("utack nack"), "utack").otherwise("general")


def chat_review_score(message: Column, by_maintainer: Column) -> Column:
    """Score of a chat message as a review, by who says it, its words and its length."""
    def told(b: Column) -> Column:
        high, n = T.contains_any(b, K.MESSAGE_REVIEW["high"]), F.length(b)
        strong = F.when(n > 100, 1.0).when(n > 50, 0.8).otherwise(0.7)
        return F.when(by_maintainer & high, strong).when(by_maintainer | high, F.when(n > 50, 0.6).otherwise(0.5)).when(T.contains_any(b, K.MESSAGE_REVIEW["medium"]), 0.3).otherwise(0.2)

    return T.lowered(message, told)


def mail_review_score(subject: Column, body: Column) -> Column:
    """Score of a mail as a review, by its words and the length of its body."""
    n = F.length(T.or_empty(body))

    def told(b: Column) -> Column:
        long = F.when(n > 200, 1.0).when(n > 100, 0.8).otherwise(0.7)
        return F.when(T.contains_any(b, K.MESSAGE_REVIEW["high"]), long).when(T.contains_any(b, K.MESSAGE_REVIEW["medium"]), F.when(n > 100, 0.6).otherwise(0.5)).otherwise(0.3)

    return T.lowered(F.concat_ws(" ", T.or_empty(body), T.or_empty(subject)), told)


def gini_words(gini: Column) -> Column:
    out = None
    for least, words in K.GINI_WORDS:
        out = F.when(gini >= least, words) if out is None else out.when(gini >= least, words)
    return out


def bands(x: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first lower bound that x exceeds."""
    out = None
    for least, name in steps:
        out = F.when(x > least, name) if out is None else out.when(x > least, name)
    return out.otherwise(otherwise)


def opacity_level(x: Column) -> Column:
    return bands(x, [(0.7, "very_high"), (0.5, "high"), (0.3, "moderate")], "low")


def homophily_level(x: Column) -> Column:
    return bands(x, [(0.7, "strong"), (0.5, "moderate")], "weak")


def ratio_words(x: Column, high: float, some: float) -> Column:
    return bands(x, [(high, "high"), (some, "moderate")], "low")


def correlation_words(r: Column) -> Column:
    size = F.when(F.abs(r) > 0.7, "strong").when(F.abs(r) > 0.3, "moderate").otherwise("weak")
    return F.concat_ws(" ", size, F.when(r >= 0, "positive").otherwise("negative"))


def review_metrics(reviews: Column) -> Column:
    """struct of counts over an array of struct(state, author, body)."""
    def n(state: str) -> Column:
        return F.size(F.filter(reviews, lambda r: F.upper(r["state"]) == state))

    nacks = F.filter(reviews, lambda r: F.lower(T.or_empty(r["body"])).contains("nack"))
    return F.struct(F.size(reviews).alias("total_reviews"), n("APPROVED").alias("approvals"), n("CHANGES_REQUESTED").alias("rejections"), n("COMMENTED").alias("comments_only"), F.size(nacks).alias("nack_count"), F.size(F.array_distinct(F.transform(reviews, lambda r: F.lower(r["author"])))).alias("unique_reviewers"))


def gap_score(*gaps: Column) -> Column:
    total = gaps[0]
    for g in gaps[1:]:
        total = total + g
    return total / len(gaps)


def rate(flag: Column) -> Column:
    return ratio(F.count_if(flag), F.count("*"))
