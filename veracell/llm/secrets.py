"""Operator 10: secrets by fixed forms and by sliding-window Shannon entropy.

Base forms (assignments, access keys, long hexadecimal runs) are found as
leftmost matches that don't overlap; a match that fails its length is dropped.
The method adds spans of kind ``entropy``: in each run of characters that keys
are made of, a window of fixed width moves one character at a time; the counts
of its characters, and from them the sum of n*log2(n), change by the one that
enters and the one that leaves. A span is the union of the windows whose
entropy reaches the bound of the run's character class. The allow list: parts of
a run that are UUIDs, digests of a named kind or placeholders suppress the
windows that touch them; runs that are numbers, dates, words, paths or camel-case
names, and so all runs of lower-case letters only, are suppressed whole, and so
are parts that a base span covers.

Defined results: null and empty texts have no spans and the hash of the empty
string; repeated rows are scanned each; an empty table gives no rows; other
columns are unread. Texts are scanned whole, in time linear in their length.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from math import log2

from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, clear_of, id_and_text

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
# a run of the class that is too short fails wherever in the run a match starts
ACCESS = re.compile("AKIA[A-Z0-9]{12,}")
HEX = re.compile("(?<![0-9a-f])[0-9a-f]{32,}")

WINDOW = 20
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Bits a character that a window must reach, by class. A window of 20 has at
#: most log2(20) = 4.32; hexadecimal runs at most 4.
BOUNDS = {"hex": 3.0, "mixed": 3.6, "letters": 3.6}
WORD = "[A-Z]?[a-z]+|[A-Z]+"
#: Parts of a run that belong to no secret: the windows that touch them are suppressed.
APART = re.compile(
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"  # UUID
    r"|(?i:(?:sha(?:1|256|512)|md5)[-=][A-Za-z0-9+/=]+"  # digests that say so
    r"|example|x{4,}|your[a-z_-]*|placeholder|abcdefghij|0123456789)"
    r"|(?P<hex>(?<![A-Za-z0-9+])(?:[0-9a-f]{20,}|[0-9A-F]{20,})(?![A-Za-z0-9+]))")  # a candidate of its own
#: Whole runs that are no secret.
ALLOWED = re.compile("|".join((
    r"[0-9+/_=-]+",  # numbers, dates, rules of signs
    rf"[/_=+-]*(?:{WORD})(?:[/_=+-]+(?:{WORD}|[0-9]{{1,4}}))*[/_=+-]*",  # words, paths, identifiers
)))
PIECE = re.compile("[A-Z]{0,3}[a-z]+|[A-Z]+|[0-9]+")
NAME = re.compile("[A-Z]{0,3}[a-z]{2,}|[A-Z]{2,8}|[0-9]{1,4}")


def identifier(run: str) -> bool:
    """Words, paths and names; those in camel case by pieces longer than chance
    makes them."""
    if ALLOWED.fullmatch(run):
        return True
    pieces = PIECE.findall(run)
    return len(run) >= 3.5 * len(pieces) and all(NAME.fullmatch(p) for p in pieces)


def char_class(run: str) -> str:
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", run):
        return "hex"
    return "mixed" if re.search("[0-9]", run) and re.search("[A-Za-z]", run) else "letters"


def high_windows(run: str, bound: float, width: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal unions of windows with entropy of at least ``bound``."""
    logs = [0.0, *(n * log2(n) for n in range(1, width + 1))]
    counts, total = Counter(), 0.0
    spans: list[list[int]] = []
    for at, c in enumerate(run):
        n = counts[c]
        total += logs[n + 1] - logs[n]
        counts[c] = n + 1
        if at >= width:
            n = counts[out := run[at - width]]
            total += logs[n - 1] - logs[n]
            counts[out] = n - 1
        if at >= width - 1 and log2(width) - total / width >= bound - 1e-9:
            start = at - width + 1
            if spans and start <= spans[-1][1]:
                spans[-1][1] = at + 1
            else:
                spans.append([start, at + 1])
    return [(a, b) for a, b in spans]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) by start, then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def candidates(text: str):
    """(start, run): runs of key characters without the parts that stand apart."""
    for m in CANDIDATE.finditer(text):
        at = m.start()
        for other in APART.finditer(m[0]):
            if m.start() + other.start() - at >= WINDOW:
                yield at, text[at : m.start() + other.start()]
            if other["hex"]:
                yield m.start() + other.start(), other["hex"]
            at = m.start() + other.end()
        if m.end() - at >= WINDOW:
            yield at, text[at : m.end()]


def entropy_spans(text: str, covered: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    found = [(at + a, at + b) for at, run in candidates(text) if not identifier(run) for a, b in high_windows(run, BOUNDS[char_class(run)])]
    free = clear_of(found, [s[:2] for s in covered])
    return [(a, b, 3) for (a, b), ok in zip(found, free) if ok]


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text."""
    # every form but an assignment needs 16 characters without white space
    if max(map(len, text.split()), default=0) < 16:
        base = [] if not any(k in (low := text.lower()) for k in KEYWORDS) else [
            (m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        return base, base
    base = base_spans(text)
    return base, sorted(base + entropy_spans(text, base), key=lambda s: (s[0], s[2]))


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, b, k in spans])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy of
    (doc_id, text); code points, ends exclusive; no shuffle."""

    def build():
        def work(ids, texts):
            found = [scan(t or "") for t in texts]
            count = lambda k: [sum(s[2] == k for s in every) for _, every in found]
            return {"doc_id": ids, "n_assign": count(0), "n_access": count(1), "n_hex": count(2),
                    "base_sha256": [hashlib.sha256(told(base).encode()).hexdigest() for base, _ in found],
                    "spans": [told(every) for _, every in found], "n_entropy": count(3)}

        return work

    return arrow_map(docs, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_entropy bigint", build)


def redact(text: str, mark: str = "<SECRET>") -> str:
    """The text with each span, overlapping ones together, replaced."""
    out, at = [], 0
    for a, b, _ in scan(text)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def op10_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(id_and_text(spark.read.parquet(f"{sf_dir}/documents.parquet")))
