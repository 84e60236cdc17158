"""Secrets in text: candidates by pattern, false positives removed by a random forest.

Candidates are known key formats, passwords in addresses, values assigned to
telling names and long runs of key characters, with or without digits. Each is
described by its length and make-up, its character transitions (likelihood
under models of secrets and of other strings), the share of it that dictionary
words cover, whether it stands in a path or address, and the words before and
after it. The dictionary is the whole words of a public vocabulary file. The
forest and the transition models are trained from labelled findings: the
caller's, or ``labelled_findings()``, a generated set of a documented size.
"""

from __future__ import annotations

import json
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhall.llm.common import texts_of, tuned
from tallyhall.llm.tokens import default_path

#: Generated findings, trees, their depth, and the share of trees' votes that makes a secret.
FINDINGS, TREES, DEPTH, VOTE = 6000, 30, 10, 0.5
#: Characters before and after a candidate that its neighbouring words are taken from.
CONTEXT = 48

# Key formats.
FORMATS = {
    "aws_id": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    "slack": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "stripe": r"\b[sr]k_live_[A-Za-z0-9]{16,}\b",
    "google": r"\bAIza[0-9A-Za-z_-]{35}\b",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "pem": r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )?PRIVATE KEY-----)?",
}
# Names that secrets are assigned to, words that speak against, words that stand in for values.
NAMES = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential", "private")
AGAINST = ("commit", "sha", "sha1", "sha256", "md5", "hash", "checksum", "digest", "etag", "uuid", "guid", "revision", "blob", "example", "sample", "test", "placeholder", "dummy", "image", "integrity", "id")
WORDS = ("your", "here", "key", "change", "changeme", "example", "sample", "test", "value", "name", "user", "admin", "default", "config", "service", "server", "client", "handler", "manager", "factory", "data", "file", "path", "index", "version", "update", "create", "delete", "request", "response", "string", "number", "module", "import", "export", "function", "return", "class", "object", "array", "list", "public", "static", "license", "warranty", "document", "password", "secret", "token", "login", "email", "address", "system", "local", "remote", "build", "release", "debug", "http", "https", "www", "com", "org", "html", "image", "the", "and", "for", "with", "this", "that")

# What a text must contain before a format's pattern is tried.
HINTS = {"aws_id": ("AKIA", "ASIA"), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "slack": ("xox",), "stripe": ("k_live_",), "google": ("AIza",), "jwt": ("eyJ",), "pem": ("PRIVATE KEY",)}

_FORMATS = {k: re.compile(v) for k, v in FORMATS.items()}
_NAMED = re.compile(r"(?:" + "|".join(map(re.escape, NAMES)) + r")[\"']?\s*$")
_VALUE = re.compile(r">?\s*[\"']?([^\s\"'<>,;]{6,})")
_SIGN = re.compile("[:=]")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*")
_LOGIN = re.compile(r"://[^\s/@:\"'<>]*:([^\s/@\"'<>]{3,})@")
_LETTERS = re.compile(r"[a-z]+")
#: Words of fewer letters cover nothing: any string has some.
SHORTEST = 4


_dictionaries: dict[str, frozenset[str]] = {}


def dictionary(path: str | None = None) -> frozenset[str]:
    """The whole words of a vocabulary file (entries with its end mark) of ``SHORTEST`` letters or more."""
    path = path or default_path("word_bpe_49k.json")
    if path not in _dictionaries:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end = model.get("end_of_word_suffix") or ""
        whole = (t[: len(t) - len(end)] for t in model["vocab"] if t.endswith(end))
        _dictionaries[path] = frozenset(w for w in whole if len(w) >= SHORTEST and w.isascii() and w.isalpha()) | frozenset(w for w in WORDS if len(w) >= SHORTEST)
    return _dictionaries[path]


def coverage(s: str, words: frozenset[str], longest: int = 20) -> float:
    """The share of a string that the dictionary's words cover, the longest first from each place."""
    covered = 0
    for m in _LETTERS.finditer(s.lower()):
        run, at = m[0], 0
        while at <= len(run) - SHORTEST:
            n = next((n for n in range(min(longest, len(run) - at), SHORTEST - 1, -1) if run[at : at + n] in words), 0)
            covered += n
            at += n or 1
    return covered / max(1, len(s))


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in order, without overlaps; the more telling pattern wins a place."""
    found: list[tuple[int, int, str]] = []
    for kind, pattern in _FORMATS.items():
        if any(h in text for h in HINTS[kind]):
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if not any(a < m.end() and m.start() < b for a, b, _ in found)]
    more, last = [(m.start(1), m.end(1), "login") for m in _LOGIN.finditer(text)] if "://" in text else [], 0
    for sign in _SIGN.finditer(text):
        at = sign.start()
        if at >= last and _NAMED.search(text[max(0, at - 24) : at].lower()) and (m := _VALUE.match(text, at + 1)):
            more.append((m.start(1), m.end(1), "assigned"))
            last = m.end(1)
    more += [(m.start(), m.end(), "run") for m in _RUN.finditer(text)]
    for kind in ("login", "assigned", "run"):
        taken = sorted((a, b) for a, b, _ in found)
        ends = [b for _, b in taken]
        for a, b, k in more:
            if k == kind:
                i = int(np.searchsorted(ends, a, side="right")) if ends else 0
                if i >= len(taken) or taken[i][0] >= b:
                    found.append((a, b, k))
    return sorted(found)


def _code(c: str) -> int:
    o = ord(c)
    if 97 <= o <= 122:
        return o - 97
    if 65 <= o <= 90:
        return 26 + o - 65
    if 48 <= o <= 57:
        return 52 + o - 48
    return 62 if o < 128 else 63


@dataclass
class Transitions:
    """Character bigram models of secrets and of other strings."""

    logp: np.ndarray = field(default_factory=lambda: np.zeros((2, 64, 64)))

    @classmethod
    def of(cls, strings: list[str], labels: np.ndarray) -> Transitions:
        n = np.full((2, 64, 64), 0.2)
        for s, y in zip(strings, labels, strict=True):
            c = [_code(x) for x in s]
            np.add.at(n[int(y)], (c[:-1], c[1:]), 1)
        return cls(np.log(n / n.sum(2, keepdims=True)))

    def gain(self, s: str) -> float:
        c = [_code(x) for x in s]
        if len(c) < 2:
            return 0.0
        return float((self.logp[1][c[:-1], c[1:]] - self.logp[0][c[:-1], c[1:]]).mean())


def describe(text: str, a: int, b: int, kind: str, t: Transitions, words: frozenset[str]) -> list[float]:
    """A candidate's features."""
    s, low = text[a:b], text[a:b].lower()
    n = len(s)
    counts = {c: s.count(c) for c in set(s)}
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    classes = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if ord(c) < 128 else 5 for c in s]
    changes = sum(x != y for x, y in zip(classes, classes[1:], strict=False)) / max(1, n - 1)
    before, after = text[max(0, a - CONTEXT) : a].lower(), text[b : b + CONTEXT].lower()
    left, right = _WORD.findall(before)[-3:], _WORD.findall(after)[:2]
    near = before[-3:]
    return [
        n, entropy, changes, coverage(s, words), t.gain(s),
        classes.count(0) / n, classes.count(1) / n, classes.count(2) / n, classes.count(3) / n,
        max(counts.values()) / n, len(counts) / n,
        float(all(c in "0123456789abcdef" for c in low)), float(n in (32, 40, 64)), float(s.count("-") == 4 and n == 36),
        float("/" in s or before[-1:] == "/" or "://" in before[-24:]), float(before.rstrip()[-1:] in "=:" and bool(before.strip())), float(near[-1:] in "\"'"),
        float(any(w in NAMES or any(k in w for k in NAMES) for w in left)), float(any(w in AGAINST for w in left)), float(any(w in AGAINST for w in right)),
        float(kind in FORMATS), float(kind == "assigned"), float(kind == "run"), float(kind == "login"), float("base64" in before[-16:]),
    ]


@dataclass
class Forest:
    """Trees as arrays: feature, threshold, children and share of label 1 of each node."""

    trees: list[tuple[np.ndarray, ...]]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 1) -> Forest:
        rng, made = np.random.default_rng(seed), []
        tried = max(1, int(math.sqrt(x.shape[1])) + 1)
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            nodes: list[list[float]] = []

            def grow(at: np.ndarray, left: int) -> int:
                k, share = len(nodes), float(y[at].mean())
                nodes.append([-1, 0.0, -1, -1, share])
                if left == 0 or len(at) < 4 or share in (0.0, 1.0):
                    return k
                best = (1e9, -1, 0.0)
                for f in rng.choice(x.shape[1], tried, replace=False):
                    v = x[at, f]
                    for cut in np.unique(np.quantile(v, (0.1, 0.25, 0.5, 0.75, 0.9))):
                        low = v <= cut
                        n = int(low.sum())
                        if 0 < n < len(at):
                            p, q = y[at[low]].mean(), y[at[~low]].mean()
                            impure = n * p * (1 - p) + (len(at) - n) * q * (1 - q)
                            if impure < best[0]:
                                best = (impure, int(f), float(cut))
                if best[1] >= 0:
                    low = x[at, best[1]] <= best[2]
                    nodes[k][:2] = [best[1], best[2]]
                    nodes[k][2] = grow(at[low], left - 1)
                    nodes[k][3] = grow(at[~low], left - 1)
                return k

            grow(rows, depth)
            a = np.array(nodes)
            made.append((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]))
        return cls(made)

    def vote(self, x: np.ndarray) -> np.ndarray:
        """Mean share of label 1 over the trees."""
        out = np.zeros(len(x))
        for f, cut, lo, hi, share in self.trees:
            at = np.zeros(len(x), int)
            while (inner := f[at] >= 0).any():
                k = at[inner]
                at[inner] = np.where(x[np.flatnonzero(inner), f[k]] <= cut[k], lo[k], hi[k])
            out += share[at]
        return out / max(1, len(self.trees))


def labelled_findings(n: int = FINDINGS, seed: int = 7) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) of generated findings, half of them secrets."""
    r, out = random.Random(seed), []
    hexa, b64, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    syllables = ["an", "er", "ti", "on", "ed", "ing", "re", "is", "or", "le", "en", "st", "ou", "ha", "sh", "be"]
    filler = lambda k: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(k))
    uuid = lambda: "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12))
    joined = lambda sep: sep.join(r.choice(WORDS) for _ in range(r.randint(3, 6)))
    quote = lambda s: r.choice(('"%s"', "'%s'", "%s")) % s
    letters, schemes = alnum[:52], ("postgres", "mysql", "amqp", "redis", "https", "mongodb", "ftp")
    # Word parts of the four languages that prose comes in, and frequent dictionary words.
    endings = ["heit", "keit", "lich", "schaft", "ung", "ver", "zu", "ein", "ment", "tion", "elle", "aux", "esque", "ique", "mente", "ción", "ando", "osos", "ness", "able", "ough", "ther", "ing", "wh", "ous", "ness"]
    common = sorted(w for w in dictionary() if 5 <= len(w) <= 9)[::7]
    name = lambda: r.choice(("token", "secret", "api_key", "password", "access_key", "auth_token", "client_secret", "apikey", "private_key"))
    secrets = [
        lambda: (f"{name()} {r.choice('=:')} ", some(hexa, r.choice((32, 40, 64)))),
        lambda: (f"{name()}=", some(b64, r.choice((24, 32, 40, 44)))),
        lambda: (f"{name()}: ", some(alnum, r.randint(20, 48))),
        lambda: ("aws_secret_access_key = ", some(b64, 40)),
        lambda: ("", "AKIA" + some(alnum.upper(), 16)),
        lambda: ("", "ghp_" + some(alnum, 36)),
        lambda: ("Authorization: Bearer ", "eyJ" + some(alnum, 30) + "." + some(alnum, 60) + "." + some(alnum, 40)),
        lambda: ("password = ", some(alnum + "!@#%^&*", r.randint(9, 20))),
        lambda: (f"{name()} {r.choice('=:')} ", some(r.choice((letters, letters.lower(), letters.upper())), r.randint(16, 48))),
        lambda: ("", some(letters, r.randint(28, 64))),
        lambda: (f"{r.choice(schemes)}://{r.choice(WORDS)}:", some(alnum, r.randint(8, 24)) + "@" + r.choice(WORDS) + ".internal:5432/" + r.choice(WORDS)),
        lambda: (f"{r.choice(schemes)}://{r.choice(WORDS)}:", r.choice(WORDS) + some("0123456789", r.randint(1, 4)) + r.choice("!#$_-") + "@" + r.choice(WORDS)),
    ]
    others = [
        lambda: (r.choice(("commit ", "revision ", "sha1 ", "blob ")), some(hexa, 40)),
        lambda: (r.choice(("sha256: ", "checksum=", "integrity hash ")), some(hexa, 64)),
        lambda: (r.choice(("md5 ", "etag: ", "digest = ")), some(hexa, 32)),
        lambda: (r.choice(("uuid ", "id = ", "")), uuid()),
        lambda: (f"{name()} = ", r.choice(("your_api_key_here", "changeme123", "x" * r.randint(8, 32), "0" * r.randint(20, 32), "example-token-value-1", "${TOKEN_FROM_ENV}", "<your-token-here-1>"))),
        lambda: ("", joined("_") + str(r.randint(1, 99))),
        lambda: ("https://www." + r.choice(WORDS) + ".com/", joined("/") + "/" + str(r.randint(1000, 99999999))),
        lambda: ("/usr/lib/", joined("-") + "-" + str(r.randint(1, 9)) + "/" + joined("_")),
        lambda: ("data:image/png;base64,", some(b64, r.randint(40, 90))),
        lambda: (f"{name()} = ", joined(r.choice(("_", ".", "")))),
        lambda: (r.choice(("phone ", "order ", "")), some("0123456789", r.randint(20, 30))),
        lambda: ("", "".join(r.choice(endings) for _ in range(r.randint(5, 9)))),
        lambda: ("", r.choice(("".join, "-".join, "_".join))(r.sample(common, r.randint(3, 6)))),
        lambda: ("", "".join(w.title() for w in r.sample(common, r.randint(3, 6)))),
        lambda: ("", r.choice("-=_") * r.randint(20, 60)),
        lambda: (f"{r.choice(schemes)}://{r.choice(WORDS)}:", r.choice(("password", "<password>", "$PASSWORD", "${DB_PASS}", "xxxxx", "pass")) + "@" + r.choice(WORDS)),
        lambda: (f"{name()}: ", r.choice(("required", "optional", "string", "missing", "expired", "invalid", "null_or_empty", "generated"))),
    ]
    for k in range(n):
        label = k % 2
        lead, value = r.choice(secrets if label else others)()
        if r.random() < 0.15:
            lead, value = lead.upper(), value.upper() if set(value) <= set(hexa) else value
        shown = quote(value) if "://" not in lead else value
        before = f"{filler(r.randint(0, 6))} {lead}"
        a = len(before) + shown.index(value)
        value = value.partition("@")[0] if "://" in lead and "@" in value else value
        out.append((f"{before}{shown} {filler(r.randint(0, 6))}", a, a + len(value), label))
    return out


@dataclass
class Scanner:
    transitions: Transitions
    forest: Forest
    words: frozenset[str] = frozenset()
    vote: float = VOTE

    @classmethod
    def train(cls, findings: list[tuple[str, int, int, int]], path: str | None = None) -> Scanner:
        """From labelled findings (text, start, end, label); the candidate that covers a finding is described."""
        words = dictionary(path)
        y = np.array([f[3] for f in findings])
        t = Transitions.of([f[0][f[1] : f[2]] for f in findings], y)
        x = []
        for text, a, b, _ in findings:
            a, b, kind = next(((lo, hi, k) for lo, hi, k in candidates(text) if lo < b and a < hi), (a, b, "run"))
            x.append(describe(text, a, b, kind, t, words))
        return cls(t, Forest.fit(np.array(x), y.astype(float)), words)

    def scan(self, text: str) -> list[tuple[int, int, str, float, bool]]:
        """(start, end, kind, score, secret) of every candidate."""
        found = candidates(text)
        if not found:
            return []
        votes = self.forest.vote(np.array([describe(text, a, b, k, self.transitions, self.words) for a, b, k in found]))
        return [(a, b, k, round(float(v), 6), bool(v >= self.vote)) for (a, b, k), v in zip(found, votes, strict=True)]

    def redact(self, text: str, mark: str = "[SECRET]") -> str:
        out, last = [], 0
        for a, b, _, _, secret in self.scan(text):
            if secret:
                out += [text[last:a], mark]
                last = b
        return "".join([*out, text[last:]])


def findings(df: DataFrame, labelled: list[tuple[str, int, int, int]] | None = None) -> DataFrame:
    """One row per candidate: ``doc_id, start, length, kind, score, is_secret, value_sha256``.

    Places are in characters. Null and empty texts have none; repeated rows
    give repeated findings; a null id is carried; a candidate whose votes are
    tied (exactly ``VOTE``) is a secret; other columns are ignored.
    """
    spark = tuned(df.sparkSession)
    shared = spark.sparkContext.broadcast(Scanner.train(labelled or labelled_findings()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            rows = []
            for doc, text in zip(batch[0].to_pylist(), texts_of(batch[1]), strict=True):
                rows += [(doc, a, b - a, k, v, s, hashlib.sha256(text[a:b].encode("utf-8", "surrogatepass")).hexdigest()) for a, b, k, v, s in shared.value.scan(text)]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "length", "kind", "score", "is_secret", "value_sha256"])

    src = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return src.mapInArrow(run, "doc_id long, start long, length long, kind string, score double, is_secret boolean, value_sha256 string")


def redact(df: DataFrame, labelled: list[tuple[str, int, int, int]] | None = None) -> DataFrame:
    """The same rows with secrets in ``text`` replaced by a mark.

    Null and empty texts stay as they are, repeated rows and ids are treated
    alike, tied votes count as a secret; other columns are kept.
    """
    spark = tuned(df.sparkSession)
    shared = spark.sparkContext.broadcast(Scanner.train(labelled or labelled_findings()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            new = pa.array([t if t is None else shared.value.redact(t) for t in batch[k].to_pylist()], batch.schema.field(k).type)
            yield batch.set_column(k, batch.schema.field(k), new)

    return df.mapInArrow(run, df.schema)
