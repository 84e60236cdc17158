"""Text functions as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of an acknowledgement, a hash and a reference to code.
ACK = r"(?im)(?:^|\s)ack(?:\s|$|[,:])"
HASH = r"(?i)[a-f0-9]{7,40}"
CODE_REFS = r"(?i)L\d+|line \d+|file:|\.(cpp|h|py|rs)"


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, however often the body names it.

    The variable of a lambda is a barrier that collapsing of projections doesn't undo.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lowered(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a text in lower case (null: empty), lowered once."""
    return let(F.lower(or_empty(c)), body)


def clean(c: Column) -> Column:
    """Runs of white space become one space, control characters go, ends are trimmed; null gives ''."""
    spaced = F.regexp_replace(or_empty(c), r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(spaced, r"[\x00-\x08\x0B-\x0C\x0E-\x1F]", ""))


def words(c: Column) -> Column:
    return F.filter(F.split(F.trim(or_empty(c)), r"\s+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def count_of(c: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    c = or_empty(c)
    return ((F.length(c) - F.length(F.replace(c, F.lit(literal), F.lit("")))) / len(literal)).cast("long")


def contains_any(c: Column, keywords: list[str]) -> Column:
    """True if any keyword is a substring; stops at the first that is."""
    return let(or_empty(c), lambda t: reduce(or_, [t.contains(k) for k in dict.fromkeys(keywords)]))


def hits(c: Column, keywords: list[str]) -> Column:
    """How many of the keywords are substrings."""
    out = F.lit(0)
    for k in dict.fromkeys(keywords):
        out = out + or_empty(c).contains(k).cast("int") * keywords.count(k)
    return out


def matching(c: Column, groups: dict[str, list[str]]) -> Column:
    """Names of the groups that have a keyword in the text, in their order."""
    return let(or_empty(c), lambda t: F.array_compact(F.array(*[F.when(contains_any(t, ks), F.lit(name)) for name, ks in groups.items()])))


def word_hits(c: Column, keywords: list[str]) -> Column:
    """Occurrences of the keywords as whole words."""
    out = F.lit(0).cast("long")
    for k in keywords:
        out = out + F.regexp_count(or_empty(c), F.lit(rf"\b{re.escape(k)}\b")).cast("long")
    return out


def issue_links(c: Column) -> Column:
    """Distinct numbers after '#', ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(or_empty(c), F.lit(r"#(\d+)"), 1), lambda x: x.cast("long"))))


def change_mentions(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(or_empty(c), F.lit(r"(?:#|pull/)(\d{4,6})"), 1), lambda x: x.cast("long"))


def mentions(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(or_empty(c), F.lit(r"@([\w.-]+)"), 1), F.lower)


def email_address(c: Column) -> Column:
    """The address in angle brackets, else the whole field; lower case."""
    inside = F.regexp_extract(or_empty(c), r"<([^>]+)>", 1)
    return F.lower(F.trim(F.when(inside != "", inside).otherwise(or_empty(c))))


def display_name(c: Column) -> Column:
    return F.trim(F.translate(F.regexp_replace(or_empty(c), r"<[^>]*>", ""), "\"'", ""))


def email_author(c: Column) -> Column:
    """Local part of the address, else the display name."""
    local = F.regexp_extract(or_empty(c), r"([\w.+-]+)@", 1)
    return F.lower(F.when(local != "", local).otherwise(display_name(c)))


def author_list(c: Column) -> Column:
    """Comma-separated authors without their addresses, lower case."""
    return F.filter(F.transform(F.split(or_empty(c), ","), lambda x: F.lower(F.trim(F.regexp_replace(x, r"<[^>]+>", "")))), lambda x: x != "")


def _lines(c: Column) -> Column:
    return F.split(or_empty(c), "\n")


# Fixed value: lines that quote.
QUOTED = r"^\s*>|^On .*wrote:|^-+ ?Original Message"


def quoted(c: Column) -> Column:
    return F.array_join(F.filter(_lines(c), lambda x: x.rlike(QUOTED)), "\n")


def unquoted(c: Column) -> Column:
    return F.trim(F.array_join(F.filter(_lines(c), lambda x: ~x.rlike(r"^\s*>")), "\n"))


def context(c: Column, pattern: str, width: int = 200) -> Column:
    """Half the width on either side of the first match, else a prefix of the width."""
    at = F.regexp_instr(or_empty(c), F.lit(pattern))
    return F.when(at > 0, F.substring(c, F.greatest(F.lit(1), at - width // 2), F.lit(width))).otherwise(F.substring(c, 1, width))


def short_id(*parts: Column, body: Column) -> Column:
    """Parts and eight hex digits of the body's MD5, joined by ':'."""
    return F.concat_ws(":", *parts, F.substring(F.md5(or_empty(body)), 1, 8))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(or_empty(c), r"<[^>]+>", "")


def html_title(c: Column) -> Column:
    return F.trim(F.regexp_extract(or_empty(c), r"(?is)<title[^>]*>(.*?)</title>", 1))


def links(c: Column) -> Column:
    return F.regexp_extract_all(or_empty(c), F.lit(r"href=\"([^\"]*)\""), 1)


def header(c: Column, name: str) -> Column:
    """A ``Name: value`` line of a text, '' if there is none."""
    return F.trim(F.regexp_extract(or_empty(c), rf"(?im)^{re.escape(name)}:[ \t]*(.+)$", 1))
