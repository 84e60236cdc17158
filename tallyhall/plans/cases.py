"""Invented records of every kind that the operators read, the same rows for Spark and for SQL.

The driver's tables hold no reviews, mails or chat; these tables do, with
texts that meet the word lists and with the edge rows that a reader of real
archives meets: blank authors, missing keys, invalid dates, letters in other
cases. They are generated by rule from a seed.
"""

from __future__ import annotations

import datetime as dt
import json
import random
from functools import cache

from pyspark.sql import DataFrame, SparkSession

MAINTAINERS = ["alice", "bob", "carol"]
PEOPLE = ["alice", "Bob", "carol", "dave", "erin", "frank", "grace", "heidi", "ivan", "judy", "Mallory", "niaj"]
TEXTS = [
    "Fix typo in the readme", "consensus change: soft fork activation of segwit", "I strongly oppose this, it is dangerous and harmful", "Concept NACK, this approach is wrong", "utACK after review, looks good",
    "Great work, excellent and essential", "We got a grant and funding from the foundation", "The company and its employer paid a salary", "A bounty of $5,000 was a reward, sponsored", "The process is unfair and arbitrary, who has authority",
    "An alternative implementation like knots may fork", "competing client, migrate or switch", "This must comply with the regulation of the government", "best practice from a professional expert, you should", "similar to bip 32 and BIP-141",
    "see #1003 and pull/1010 for details", "please look at #1017, #1017 and #99", "thanks, please consider, maybe you could", "obviously wrong, you should not do this, terrible waste", "Security vulnerability: exploit risk",
    "performance is slow, optimize the bottleneck", "tests are missing, needs more coverage", "duplicate of an existing change", "out of scope, design problem and error", "I am worried and skeptical, not ideal", "maybe, not sure, unclear",
    "decentralization and governance matter: trust and censorship", "merge decision, approve it", "plain words only", "donation from a sponsor, academic research grant", "the court and the law, a lawsuit, sec and kyc", "NACK: veto, against it", "I support it, sounds good",
    "ends strongly", "support from all", "  spaced \t text\n over  lines ", "ack", "",
]

SCHEMAS = {
    "changes": "number long, author string, state string, merged boolean, merged_by string, created string, merged_at string, title string, body string, additions long, deletions long, files long",
    "reviews": "number long, seq long, author string, state string, body string, ts string",
    "comments": "number long, seq long, author string, body string, ts string",
    "issues": "number long, author string, title string, body string, state string, created string",
    "mails": "message_id string, sender string, date string, subject string, body string, in_reply_to string",
    "chat": "seq long, channel string, nickname string, ts string, message string",
    "signers": "tag string, is_signed boolean, signer_email string, signer_name string, date string",
    "commits": "sha string, message string, parents long, author string, date string",
    "proposals": "number long, title string, author string, status string",
    "aliases": "unified string, platform string, id string",
    "archive": "path string, sender string, date string, content string",
    "raw": "id long, json string",
}


def _day(r: random.Random, lo: int = 2011, hi: int = 2024) -> dt.datetime:
    return dt.datetime(lo, 1, 1) + dt.timedelta(hours=r.randint(0, (hi - lo) * 8766))


def _iso(t: dt.datetime) -> str:
    return t.strftime("%Y-%m-%dT%H:%M:%S")


@cache
def rows(name: str) -> list[tuple]:
    """The rows of one table."""
    r = random.Random(name)
    pick, who = lambda: r.choice(TEXTS), lambda: r.choice(PEOPLE)
    out: list[tuple] = []
    if name == "changes":
        for k in range(110):
            t = _day(r)
            merged = r.random() < 0.6
            state = "merged" if merged and r.random() < 0.3 else "closed" if merged or r.random() < 0.6 else "open"
            end = _iso(t + dt.timedelta(hours=r.randint(-30, 3000))) if merged else None
            out.append((1001 + k, who(), state, merged, who().lower() if merged else None, _iso(t), end, pick(), r.choice([pick() + ". " + pick(), pick(), None]), r.choice([0, 3, 40, 250, 1500]), r.randint(0, 90), r.randint(0, 9)))
        out += [(None, "dave", "open", False, None, "2020-01-01T00:00:00", None, "no number", "x", 1, 1, 1), (0, "erin", "open", False, None, "2020-01-02T00:00:00", None, "zero", "x", 1, 1, 1), (1300, "", "open", False, None, "2020-01-03T00:00:00", None, "blank author", "x", 1, 1, 1), (1301, None, "open", False, None, "not a date", None, "no author", "x", 1, 1, 1), (1302, "frank", "open", False, None, "not a date", None, "bad  date", "x", 1, 1, 1)]
    elif name == "reviews":
        for k in range(230):
            out.append((r.randint(1001, 1110), k, who(), r.choice(["APPROVED", "CHANGES_REQUESTED", "COMMENTED", "DISMISSED"]), pick(), _iso(_day(r))))
    elif name == "comments":
        for k in range(230):
            out.append((r.randint(1001, 1110), k, r.choice([who(), who(), ""]), r.choice([pick(), pick(), None]), _iso(_day(r))))
        # People of few words, in two periods.
        for k, (p, early, late) in enumerate([("olga", 5, 5), ("peggy", 32, 5), ("quinn", 24, 32), ("rupert", 28, 24), ("sybil", 5, 28), ("trent", 33, 34), ("victor", 32, 32), ("walter", 34, 33)]):
            out += [(1001 + k, 500 + 2 * k, p, TEXTS[early], "2015-01-01T00:00:00"), (1001 + k, 501 + 2 * k, p, TEXTS[late], "2020-01-01T00:00:00")]
        out += [(1001, 600, "yara", "ends strongly", "2015-01-01T00:00:00"), (1001, 601, "yara", "oppose", "2015-01-02T00:00:00")]
    elif name == "issues":
        for k in range(60):
            out.append((2001 + k, who(), pick(), r.choice([pick(), None]), r.choice(["open", "closed"]), _iso(_day(r))))
        out += [(None, "dave", "no number", "x", "open", "2020-01-01T00:00:00"), (2300, "", "blank", "x", "open", "2020-01-01T00:00:00")]
    elif name == "mails":
        for k in range(90):
            p = who()
            out.append((f"<m{k}@list>", r.choice([f"{p} <{p.lower()}@mail.example>", f"{p.lower()}@mail.example"]), _iso(_day(r)), pick(), pick() + " " + pick(), r.choice([None, "", f"<m{r.randint(0, 89)}@list>"])))
        out += [("<x1@list>", "", "2020-01-01T00:00:00", "no sender", "x", None), ("<x2@list>", "dave <dave@mail.example>", "never", "no date", "x", None), ("<x3@list>", "no address", "2020-01-05T00:00:00", "s", "x", None)]
    elif name == "chat":
        for k in range(160):
            out.append((k, r.choice(["dev", "review"]), r.choice([who().lower(), who() + "_", who()]), _iso(_day(r)), r.choice([pick(), "@" + who().lower() + " " + pick()])))
        out += [(900, "dev", "", "2020-01-01T00:00:00", "no nick"), (901, "dev", "dave", None, "no time")]
    elif name == "signers":
        for k in range(30):
            p = who()
            signed = r.random() < 0.8
            out.append((f"v0.{k + 1}", signed, f" {p}@Mail.example " if signed else None, f"{p.title()} Smith" if signed else None, _iso(dt.datetime(2012, 1, 1) + dt.timedelta(days=150 * k))))
        out.append((None, True, "x@y", "X", "2020-01-01T00:00:00"))
    elif name == "commits":
        for k in range(80):
            n = r.randint(1001, 1110)
            out.append((f"{r.getrandbits(160):040x}", r.choice([f"Merge #{n}: some change", f"Merge pull request #{n} from x", f"refactor, see #{n}", "plain commit", f"Merge branch, #{n} and #{n + 1}"]), r.choice([1, 2]), who(), _iso(_day(r, 2012, 2024))))
        out += [("", "no hash", 1, "dave", "2020-01-01T00:00:00"), (None, "null hash", 1, "dave", "2020-01-01T00:00:00")]
    elif name == "proposals":
        for n in (9, 16, 32, 34, 39, 141, 173, 340, 341, 342):
            out.append((n, f"Proposal {n}", ", ".join(f"{p} <{p.lower()}@mail.example>" for p in r.sample(PEOPLE, r.randint(1, 3))), r.choice(["Final", "Draft", "Rejected"])))
    elif name == "aliases":
        for p in PEOPLE[:6]:
            out += [(p.lower(), "forge", p), (p.lower(), "chat", p.lower() + "_"), (p.lower(), "mail", f"{p.lower()}@mail.example")]
    elif name == "archive":
        for k in range(40):
            out.append((r.choice(["forum/post", "mails/letter", "notes/page"]) + f"-{k}.txt", r.choice(["Founder <founder@first.example>", "someone@else.example", ""]), _iso(_day(r, 2009, 2012)), pick() + ". " + pick() + "."))
    elif name == "raw":
        good = {"number": 7, "author": "alice", "created_at": "2020-01-01T00:00:00Z", "state": "open", "reviews": [], "comments": []}
        kinds = [{}, {"number": "7"}, {"number": 7.5}, {"author": None}, {"created_at": "yesterday"}, {"state": "done"}, {"reviews": {}}, {"comments": "none"}, {"number": True, "state": "x", "comments": 3}]
        cases = [{**good, **k} for k in kinds] + [{k: v for k, v in good.items() if k != gone} for gone in good] + [{}]
        out = [(k, json.dumps(c)) for k, c in enumerate(cases)]
    return out


def case(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame(rows(name), SCHEMAS[name])


_SQL = {"long": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN"}


def _literal(x) -> str:
    if x is None:
        return "NULL"
    return str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


@cache
def given(*names: str) -> str:
    """``WITH`` and the named tables as literal rows."""
    parts = []
    for n in names:
        cols = [c.split() for c in SCHEMAS[n].split(", ")]
        listed = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows(n))
        picked = ", ".join(f'CAST("{c}" AS {_SQL[k]}) AS "{c}"' for c, k in cols)
        named = ", ".join(f'"{c}"' for c, _ in cols)
        parts.append(f"{n} AS (SELECT {picked} FROM (VALUES {listed}) t({named}))")
    return "WITH " + ", ".join(parts)
