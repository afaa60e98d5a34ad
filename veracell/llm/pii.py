"""Operator 2: personal data by fixed forms and a semi-Markov random field.

Base spans of four kinds are leftmost matches that don't overlap within a kind;
those that fail their test are dropped without another try. The method adds
spans that no base form describes (national telephone numbers, cards of 13 to
15 digits, spelled-out addresses): a semi-Markov conditional random field over
tokens scores whole candidate segments, of at most ``MAX_TOKENS`` tokens and ``MAX_CHARS`` characters, by
features of the entire span, and dynamic programming chooses boundaries and
kinds together. A segment is a candidate only if its span has the parts its
kind must have; away from digits and from "at"/"dot" no segment is one, so the
best labelling there is known and decoding each window around such tokens gives
the best labelling of the whole text. Base spans stay; a found segment that
meets a base span is dropped.

The field is trained here, by gradient steps on the conditional likelihood of
generated sentences (``TRAIN_SENTENCES``, fixed seed).

Defined results: null and empty texts have no spans; repeated rows are scanned
each; an empty table gives no rows; other columns are unread. Texts are scanned
whole, in time linear in their length.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from math import exp, log
from random import Random

from pyspark.sql import DataFrame, SparkSession

from . import vocab
from .common import arrow_map, clear_of, id_and_text, map_text

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if k % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """As the pattern's leftmost matches, but linear on long runs: a match
    starts where the run of local characters before an @ starts."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)  # the run can't start before a failed @: it isn't a local character
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), sorted."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# ---- the field

MAX_TOKENS = 16
MAX_CHARS = 120
MARGIN = 40
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
TRIGGER = re.compile(r"[0-9]+|(?i:(?<![a-z])dot(?![a-z]))")
OUTSIDE = 4
CUES = {w: c for c, ws in {
    "mail": "email mail e contact write address", "ip": "ip host server addr ping node", "card": "card visa mastercard amex credit debit payment",
    "phone": "phone tel call telephone mobile cell fax dial reach ring", "number": "order invoice version isbn ref id page chapter section year total price room v no item",
}.items() for w in ws.split()}
NUMERIC = frozenset("()-./+ []")
TOP = frozenset("com org net edu gov io info biz eu de uk fr es it nl ch at be se no dk fi pl cz pt ie us ca au nz jp cn in br ru za mx".split())


class Window:
    """Tokens around triggers, with what spans need precomputed."""

    def __init__(self, text: str, tokens: list[tuple[int, int]]):
        self.text, self.at = text, tokens
        self.tok = [text[a:b] for a, b in tokens]
        self.digit = [t.isdigit() and t.isascii() for t in self.tok]
        self.gap = [False, *(b[0] > a[1] for a, b in zip(tokens, tokens[1:]))]
        self.low = [t.lower() for t in self.tok]

    def cue(self, i: int) -> str:
        for k in range(i - 1, max(-1, i - 4), -1):
            if c := CUES.get(self.low[k]):
                return c
        return "none"

    def candidates(self, i: int):
        """(end, kind, features) of the segments that may start at token i."""
        first, n = self.tok[i], len(self.tok)
        if self.digit[i] or first in "+(":
            if i and not self.gap[i] and self.tok[i - 1][-1].isalnum():
                return
            digits, shape, groups = "", "", []
            for j in range(i, min(n, i + MAX_TOKENS)):
                t = self.tok[j]
                if self.at[j][1] - self.at[i][0] > MAX_CHARS:
                    return
                if self.digit[j]:
                    digits += t
                    groups.append(len(t))
                    if len(digits) > 19:
                        return
                elif t not in NUMERIC:
                    return
                shape += ("_" if self.gap[j] and j > i else "") + (f"d{len(t)}" if self.digit[j] else t)
                if not self.digit[j] or len(digits) < 4:
                    continue
                if j + 1 < n and not self.gap[j + 1] and self.tok[j + 1][0].isalnum():
                    continue
                signs = set(shape) - set("0123456789d_")
                if 7 <= len(digits) <= 15 and not signs & set("[]"):
                    yield j + 1, 3, self.features(3, i, j, shape, groups, digits)
                if len(digits) >= 13 and signs <= {"-"}:
                    yield j + 1, 2, self.features(2, i, j, shape, groups, digits)
                if len(groups) == 4 and shape.count(".") == 3 and signs <= set(".[]") and max(map(int, re.findall("[0-9]+", self.text[self.at[i][0] : self.at[j][1]]))) <= 255:
                    yield j + 1, 1, self.features(1, i, j, re.sub("[0-9]", "", shape), groups, digits)
        if self.tok[i].isalnum():
            at = dots = spelled = 0
            words = ""
            for j in range(i, min(n, i + MAX_TOKENS)):
                t = self.low[j]
                if t in ("at", "@"):
                    at += 1
                    words += "A"
                elif t in ("dot", "."):
                    dots += 1
                    spelled += t == "dot"
                    words += "D"
                elif self.tok[j].isalnum():
                    words += "w" if not words.endswith("w") else "W"
                    if not at and dots == 0 and words.count("w") + words.count("W") > 3:
                        return
                elif t not in "()[]{}-_":
                    return
                if at > 1 or self.at[j][1] - self.at[i][0] > MAX_CHARS:
                    return
                if at and spelled and self.tok[j].isalnum() and t != "dot":
                    yield j + 1, 0, [(0, "bias"), (0, "words", words[:12]), (0, "cue", self.cue(i)), (0, "bracket", "[" in self.tok[i : j + 1] or "(" in self.tok[i : j + 1]),
                                     (0, "tail", len(t) if len(t) < 5 else 5), (0, "top", t in TOP),
                                     (0, "next", self.low[j + 1] if j + 1 < n and self.low[j + 1] in ("dot", ".", "at") else "")]

    def features(self, kind, i, j, shape, groups, digits):
        return [(kind, "bias"), (kind, "shape", shape), (kind, "n", len(digits)), (kind, "groups", min(len(groups), 6)), (kind, "cue", self.cue(i)),
                (kind, "luhn", luhn(digits)), (kind, "first", self.tok[i][0] if not self.digit[i] else "d"), (kind, "max", max(groups)),
                (kind, "date", bool(re.fullmatch(r"d4-d2-d2.*|d[12]/d[12]/d[24].*|d[12]\.d[12]\.d4.*", shape))),
                (kind, "money", i > 0 and self.tok[i - 1] in "$€£#")]

    def outside(self, i: int):
        t = self.tok[i]
        return [(OUTSIDE, "d" if self.digit[i] else "a" if t.isalnum() else "p"), (OUTSIDE, "len", len(t) if self.digit[i] and len(t) < 12 else 0)]


def lattice(w: Window):
    """Segments by start: (end, kind, features)."""
    return [[(i + 1, OUTSIDE, w.outside(i)), *w.candidates(i)] for i in range(len(w.tok))]


def total(weights, feats) -> float:
    return sum(weights.get(f, 0.0) for f in feats)


def decode(weights, w: Window) -> list[tuple[int, int, int]]:
    """The best labelling's segments as (kind, start, end) in the text."""
    n, segments = len(w.tok), lattice(w)
    best: list[dict[int, tuple[float, int, int]]] = [{} for _ in range(n + 1)]
    best[0][OUTSIDE] = (0.0, -1, -1)
    for i in range(n):
        for end, kind, feats in segments[i]:
            s = total(weights, feats)
            score, prev = max((v[0] + weights.get(("t", k, kind), 0.0), -k) for k, v in best[i].items())
            if kind not in best[end] or score + s > best[end][kind][0]:
                best[end][kind] = (score + s, i, -prev)
    out, at = [], n
    kind = max(best[n], key=lambda k: best[n][k][0])
    while at > 0:
        _, start, prev = best[at][kind]
        if kind != OUTSIDE:
            out.append((kind, w.at[start][0], w.at[at - 1][1]))
        at, kind = start, prev
    return out[::-1]


def logsum(xs) -> float:
    top = max(xs)
    return top + log(sum(exp(x - top) for x in xs))


def gradient(weights, w: Window, gold: set[tuple[int, int, int]]):
    """d log p(gold) / d weights, by forward and backward sums over segments."""
    n, segments = len(w.tok), lattice(w)
    scored = [[(e, k, f, total(weights, f)) for e, k, f in row] for row in segments]
    trans = lambda a, b: weights.get(("t", a, b), 0.0)
    ahead: list[dict[int, float]] = [{} for _ in range(n + 1)]
    ahead[0][OUTSIDE] = 0.0
    for i in range(n):
        for e, k, _, s in scored[i]:
            x = logsum([v + trans(p, k) for p, v in ahead[i].items()]) + s
            ahead[e][k] = logsum([ahead[e][k], x]) if k in ahead[e] else x
    back: list[dict[int, float]] = [{} for _ in range(n)] + [{k: 0.0 for k in range(5)}]
    for i in range(n - 1, -1, -1):
        for p in ahead[i]:
            back[i][p] = logsum([trans(p, k) + s + back[e][k] for e, k, _, s in scored[i]])
    z = logsum(list(ahead[n].values()))
    out: dict = defaultdict(float)
    for i in range(n):
        for e, k, f, s in scored[i]:
            for p, v in ahead[i].items():
                pr = exp(v + trans(p, k) + s + back[e][k] - z)
                if pr > 1e-9:
                    out["t", p, k] -= pr
                    for x in f:
                        out[x] -= pr
    at, prev = 0, OUTSIDE
    ends = {i: (j, k) for k, i, j in gold}
    while at < n:
        end, kind = ends.get(at, (at + 1, OUTSIDE))
        feats = next((f for e, k, f in segments[at] if (e, k) == (end, kind)), None)
        if feats is None:
            end, kind, feats = segments[at][0]
        out["t", prev, kind] += 1
        for x in feats:
            out[x] += 1
        at, prev = end, kind
    return out


TRAIN_SENTENCES = 900
FILLER = "the of and we to you will then please data was with it an is by in report some other thing la el und der que les".split()


def generated(n: int, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Sentences with the spans they were made with, and lookalikes without any."""
    r = Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    words = lambda k: " ".join(r.choice(FILLER) for _ in range(k))
    name = lambda: r.choice("ann bob carla dmitri eve farid gus hana".split())

    def card(k):
        body = r.choice("3456") + d(k - 2)
        return body + next(c for c in "0123456789" if luhn(body + c))

    def phone():
        a, b, c = r.choice("23456789") + d(2), d(3), d(4)
        return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"0{d(2)} {d(4)} {d(4)}", f"({a}) {b} {c}",
                         " ".join([f"0{d(1)}", d(2), d(2), d(2), d(2)]), f"0{d(2)} {d(7)}", f"0{d(3)} {d(7)}", f"(0{d(2)}) {d(6)}-{d(2)}", f"0{d(4)} {d(6)}", f"{a}-{c}", f"0{d(2)}/{d(7)}"])

    def cardlike():
        x = card(r.choice([13, 14, 15, 15]))
        return x if r.random() < 0.5 or len(x) != 15 else f"{x[:4]} {x[4:10]} {x[10:]}"

    def mail():
        at, dot = r.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) ")])
        return name() + r.choice(["", dot + name()]) + at + r.choice("example mailhost corp uni clinic shop".split()) + dot + r.choice(["com", "org", "net", "io", "de", "edu", "fr", f"co{dot}uk"])

    def ip():
        return r.choice([" . ", "[.]"]).join(str(r.randint(0, r.choice([9, 99, 254]))) for _ in range(4))

    def lookalike():
        return r.choice([lambda: f"order {d(8)}", lambda: f"invoice no {d(10)}", lambda: f"{r.randint(1900, 2030)}-0{r.randint(1, 9)}-1{d(1)}", lambda: f"version {d(1)}.{d(1)}.{d(2)}.{d(4)}",
                         lambda: f"$ {d(3)}.{d(2)}", lambda: f"isbn 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"id {d(16)}", lambda: f"ref {d(13)}", lambda: f"page {d(3)}", lambda: f"{d(1)}.{d(2)}.20{d(2)}",
                         lambda: f"{d(4)} {d(4)}", lambda: f"at {d(1)} dot points", lambda: "look at the dot on it", lambda: f"{r.choice(FILLER)} at {r.choice(FILLER)} dot {r.choice(FILLER)}", lambda: f"meet at noon dot {r.choice(FILLER)}",
                         lambda: f"{d(1)} . {d(1)} to {d(1)} . {d(1)}", lambda: f"{d(4)} {d(4)} {d(4)}", lambda: f"{d(2)} {d(2)} {d(2)}", lambda: f"{d(8)} from 0{r.randint(1, 9)}.1{d(1)}.20{d(2)}",
                         lambda: f"{d(3)} [{d(1)}] . {d(2)}", lambda: f"total {d(7)}", lambda: f"{d(9)}", lambda: f"{d(12)}", lambda: f"{d(4)}-{d(4)}"])()

    cues = {0: ["email", "mail", "contact", "write", ""], 1: ["ip", "host", "server", ""], 2: ["card", "visa", "amex", "credit", ""], 3: ["phone", "call", "tel", "fax", "reach", "mobile", ""]}
    out = []
    for _ in range(n):
        text, spans = words(r.randint(0, 4)), []
        for _ in range(r.randint(1, 2)):
            kind = r.choice([0, 1, 2, 3, 3, 4, 4, 4])
            if kind == 4:
                text += " " + lookalike()
            else:
                item = (mail, ip, cardlike, phone)[kind]()
                text += " " + r.choice(cues[kind]) + r.choice(["", ":", " is"]) + " "
                spans.append((kind, len(text), len(text) + len(item)))
                text += item
            text += r.choice(["", ".", ",", ""]) + " " + words(r.randint(1, 4))
        out.append((text, spans))
    return out


def windows(text: str):
    """Windows around digits and spelled-out dots, wider than any segment."""
    reach = MAX_CHARS + MARGIN
    spans: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    for a, b in spans:
        if tokens := [m.span() for m in TOKEN.finditer(text, a, b)]:
            yield Window(text, tokens)


def train(sentences=None, rounds: int = 5, rate: float = 0.4, decay: float = 2e-4) -> dict:
    weights: dict = {}
    sentences = generated(TRAIN_SENTENCES) if sentences is None else sentences
    step = 0
    for _ in range(rounds):
        for text, spans in sentences:
            tokens = [m.span() for m in TOKEN.finditer(text)]
            starts, ends = {a: k for k, (a, _) in enumerate(tokens)}, {b: k + 1 for k, (_, b) in enumerate(tokens)}
            gold = {(k, starts[a], ends[b]) for k, a, b in spans}
            eta = rate / (1 + step / 800)
            for f, g in gradient(weights, Window(text, tokens), gold).items():
                weights[f] = weights.get(f, 0.0) * (1 - eta * decay) + eta * g
            step += 1
    return {f: round(x, 4) for f, x in weights.items() if abs(x) > 1e-4}


def field() -> dict:
    """The trained weights; made once a process, the same every time."""
    return vocab.once("pii-field", train)


def scan(weights: dict, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, each (kind, start, end) sorted by kind, start."""
    base = sorted(base_spans(text))
    if not TRIGGER.search(text):
        return base, base
    added = [s for w in windows(text) for s in decode(weights, w)]
    free = clear_of([s[1:] for s in added], sorted(s[1:] for s in base))
    added = [s for s, ok in zip(added, free) if ok]
    return base, sorted({*base, *added})


def told(spans) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for k, a, b in spans])


def redacted(text: str, spans) -> str:
    """Each span, overlapping ones together, becomes <KIND>."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, base_sha256, spans, n_added and n_spans of (doc_id, text);
    code points, ends exclusive; no shuffle."""
    weights = field()

    def build():
        def work(ids, texts):
            found = [scan(weights, t or "") for t in texts]
            out = {f"n_{kind}": [sum(s[0] == k for s in base) for base, _ in found] for k, kind in enumerate(KINDS)}
            return {"doc_id": ids, **out, "base_sha256": [hashlib.sha256(told(base).encode()).hexdigest() for base, _ in found],
                    "spans": [told(every) for _, every in found], "n_added": [len(every) - len(base) for base, every in found], "n_spans": [len(every) for _, every in found]}

        return work

    return arrow_map(docs, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint, n_spans bigint", build)


def redact_text(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, their text redacted; a null text stays null."""
    weights = field()
    return map_text(docs, text_col, lambda texts: [t and redacted(t, scan(weights, t)[1]) for t in texts.to_pylist()])


def op2_semi_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(id_and_text(spark.read.parquet(f"{sf_dir}/documents.parquet")))
