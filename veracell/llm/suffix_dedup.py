"""Operator 3: repeated byte strings by depth-limited radix sort of suffixes.

Every suffix is ordered through ``DEPTH`` bytes only: two suffixes with equal
first ``DEPTH`` bytes are a repeated window, and nothing deeper is looked at.

Suffixes that can be equal are brought together first. The anchor of a window is
its smallest hashed ``GRAM``-gram (leftmost if tied); equal windows have the same
anchor at the same place. Neighbouring windows with one anchor form a run, about
1 in 35 bytes, and runs are what is shuffled, into a bucket for each anchor.
Buckets of one run are dropped, and runs of one bucket that are equal as a whole
are copies: they give one row, so what a third of all texts share is one row too.

Within a bucket the suffixes of all its runs are sorted by radix, the most
significant digit first: ``DIGIT`` bytes a pass, as unsigned big-endian numbers.
After each pass a suffix that is alone in its group is dropped. The groups left
after the last pass are exactly the repeated windows; all but the first of each
repeat. A bucket of more than ``GROUP_RUNS`` runs goes through the same passes
spread over all tasks, with wider digits (``DEPTHS``): a pass keeps the suffixes
whose bytes so far stand more than once, by a count combined before its shuffle.

"First" is by doc_id, then start. Anchors and whole runs are told apart by 64-bit
hashes, together 128 bits; the sort compares bytes. Joins back are such that
adaptive execution can split them, so no string is one task's burden.

Defined results: a null or empty text has no bytes; a text shorter than the
depth loses nothing; a row with a null doc_id is returned whole and matches
nothing; doc_id names a document, so repeated rows of one doc_id are one document
and come back each with its result; an empty table gives no rows; other columns
are unread.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, id_and_text

DEPTH = 100
GRAM = 32
#: Bytes of a digit in a task, and bytes known after each pass of a large bucket.
DIGIT = 8
DEPTHS = (40, 70, DEPTH)
#: Runs of one bucket that one task sorts; of more, each suffix is a row of its own.
GROUP_RUNS = 1 << 12
#: Runs whose suffixes are sorted together.
SORT_RUNS = 1 << 12
#: The most window starts of one document in a piece.
PIECE = 1 << 22
#: Bytes of the shorter pieces that are hashed together, so that arrays stay in a core's cache.
TOGETHER = 1 << 17
_POSITION = 26
_R = np.random.RandomState(20240229)
_BYTE = _R.randint(0, 1 << 62, 256, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = [int(x) * 2 + 1 for x in _R.randint(0, 1 << 62, 8, dtype=np.int64)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of the GRAM bytes from each position on; those at the
    last GRAM - 1 positions mean nothing."""
    h = _BYTE[data]
    step = 1
    while step < GRAM:
        nxt = h * np.uint64(_ODD[step.bit_length() - 1])
        nxt[:-step] += h[step:]
        h = nxt
        step *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def runs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """(piece, first window, windows, anchor) of each run, and the gram hashes.

    ``starts`` and ``sizes`` are of the pieces laid end to end in ``data``.
    """
    n, span = len(data), DEPTH - GRAM + 1
    if n < DEPTH:
        none = np.empty(0, np.int64)
        return none, none, none, none, np.empty(0, np.uint64)
    hashes = gram_hashes(data)
    low = hashes & ~np.uint64((1 << _POSITION) - 1)
    low |= np.arange(n, dtype=np.uint64)
    size = 1
    while size * 2 <= span:
        np.minimum(low[: n - size], low[size:], out=low[: n - size])
        size *= 2
    if span > size and n > span - size:
        np.minimum(low[: n - (span - size)], low[span - size :], out=low[: n - (span - size)])
    # a run begins where the anchor changes or a piece begins, and ends at its piece's last window
    ends = starts + np.maximum(sizes - DEPTH + 1, 0)
    fresh = np.ones(n, bool)
    np.not_equal(low[1:], low[:-1], out=fresh[1:])
    fresh[starts] = True
    fresh[ends[ends < n]] = True
    lo = np.flatnonzero(fresh)
    count = np.diff(np.append(lo, n))
    piece = np.searchsorted(starts, lo, side="right") - 1
    inside = lo < ends[piece]
    piece, lo, count = piece[inside], lo[inside], count[inside]
    return piece, lo, count, (low[lo] & np.uint64((1 << _POSITION) - 1)).astype(np.int64), hashes


def pieces(ids, texts):
    """Groups of (doc_id, offset, bytes) of bounded size; a long text is cut so
    that each window start is in one piece."""
    held, size = [], 0
    for doc_id, text in zip(ids, texts):
        if doc_id is None or not text:
            continue
        raw = text.encode()
        for offset in range(0, max(1, len(raw) - DEPTH + 1), PIECE):
            part = raw[offset : offset + PIECE + DEPTH - 1]
            if held and size + len(part) > TOGETHER:
                yield held
                held, size = [], 0
            held.append((doc_id, offset, part))
            size += len(part)
    if held:
        yield held


def earlier_equals(*keys: np.ndarray) -> np.ndarray:
    """How many rows before each one have the same keys (exact only up to 2)."""
    mixed = np.zeros(len(keys[0]), np.uint64)
    for k in keys:
        mixed = (mixed ^ k.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    if len(np.unique(mixed)) == len(mixed):
        return np.zeros(len(mixed), np.int64)
    order = np.lexsort(keys[::-1])  # stable: equal rows keep their order
    same = np.ones(len(order) - 1, bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    one = np.concatenate(([False], same))
    out = np.empty(len(order), np.int64)
    out[order] = one.astype(np.int64) + np.concatenate(([False], one[:-1] & one[1:]))
    return out


def anchors(docs: DataFrame, keys_only: bool) -> DataFrame:
    """Rows of runs: kg (each at most twice a piece of text), or kg, rh, doc, lo, n, own.

    A run that stands earlier in its own piece of text too is no candidate for the
    first: such runs are ``own`` rows, those that meet as one row, so a document
    that repeats itself gives few rows.
    """
    schema = "kg bigint" if keys_only else "kg bigint, rh bigint, doc bigint, lo bigint, n int, own boolean"
    names = ["kg", "rh", "doc", "lo", "n", "own"]

    def run(batches):
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for group in pieces(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    raw = b"".join([p for _, _, p in group])
                    data = np.frombuffer(raw, np.uint8)
                    sizes = np.array([len(p) for _, _, p in group], np.int64)
                    starts = np.cumsum(sizes) - sizes
                    piece, lo, n, anchor, hashes = runs(data, starts, sizes)
                    if not len(lo):
                        continue
                    kg = hashes[anchor].view(np.int64)
                    doc = np.array([d for d, _, _ in group], np.int64)[piece]
                    if keys_only:
                        yield pa.RecordBatch.from_arrays([pa.array(kg[earlier_equals(piece, kg) < 2])], names=["kg"])
                        continue
                    view = memoryview(raw)
                    rh = np.array([digest(view[a : a + k + DEPTH - 1], s) for a, k, s in zip(lo.tolist(), n.tolist(), (anchor - lo).tolist())], np.uint64).view(np.int64)
                    offset = np.array([o for _, o, _ in group], np.int64)[piece]
                    own = earlier_equals(piece, kg, rh) > 0
                    # own runs of one piece whose spans meet become the first of them, longer
                    go_on = np.zeros(len(own), bool)
                    go_on[1:] = own[1:] & own[:-1] & (piece[1:] == piece[:-1])
                    head = np.flatnonzero(~go_on)
                    last = np.append(head[1:], len(own)) - 1
                    n = (lo[last] + n[last] - lo[head]).astype(np.int32)
                    rows = [kg[head], rh[head], doc[head], (lo - starts[piece] + offset)[head], n, own[head]]
                    yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=names)

    return docs.mapInArrow(run, schema)


def contexts(asked: DataFrame) -> DataFrame:
    """kg, large, doc, lo, bytes of the runs asked for; rows (doc, text, asked)."""
    types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
    names = ["kg", "large", "doc", "lo", "bytes"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for doc, text, wanted in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns]):
                    raw = text.encode()
                    rows += [(r["kg"], r["large"], doc, r["lo"], raw[r["lo"] : r["lo"] + r["n"] + DEPTH - 1]) for r in wanted]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return asked.mapInArrow(run, "kg bigint, large boolean, doc bigint, lo bigint, bytes binary")


def radix_repeats(digits: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which suffixes equal, through DEPTH bytes, an earlier one of their group.

    ``at`` has the suffixes' starts in the order of their rank; ``digits`` the big-endian
    number of the DIGIT bytes from each position on.
    """
    live = np.arange(len(at))
    for depth in range(0, DEPTH, DIGIT):
        digit = digits[at[live] + depth]
        if DEPTH - depth < DIGIT:
            digit = digit >> np.uint64(8 * (DIGIT - DEPTH + depth))
        order = np.lexsort((digit, group))  # stable: equal suffixes keep their rank
        group, digit, live = group[order], digit[order], live[order]
        fresh = np.ones(len(live), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        group = np.cumsum(fresh)
        shared = ~(fresh & np.append(fresh[1:], True))
        live, group, fresh = live[shared], group[shared], fresh[shared]
        if not len(live):
            break
    return live[~fresh] if len(live) else live


def suffixes(runs_: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of runs end to end, the start of each suffix and its run."""
    data = np.frombuffer(b"".join(runs_), np.uint8)
    size = np.array([len(r) for r in runs_], np.int64)
    n = size - DEPTH + 1
    run = np.repeat(np.arange(len(runs_)), n)
    return data, np.arange(n.sum()) + np.repeat(np.cumsum(size) - size - np.cumsum(n) + n, n), run


def spans_in(keys: np.ndarray, docs: np.ndarray, los: np.ndarray, runs_: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of the repeats among runs in order of (key, doc, lo)."""
    data, at, run = suffixes(runs_)
    padded = np.concatenate((data, np.zeros(DIGIT, np.uint8)))
    digits = np.lib.stride_tricks.sliding_window_view(padded, DIGIT)[: len(data)].copy().view(">u8").ravel().astype(np.uint64)
    hit = np.zeros(len(at), bool)
    hit[radix_repeats(digits, at, keys[run])] = True
    # neighbouring suffixes of one run that repeat are one span
    place = np.flatnonzero(hit)
    head = np.ones(len(place), bool)
    head[1:] = (np.diff(place) > 1) | (run[place[1:]] != run[place[:-1]])
    first, last = place[head], place[np.append(np.flatnonzero(head)[1:] - 1, len(place) - 1)] if len(place) else place
    offset = np.cumsum([0, *map(len, runs_)])[run[first]]
    start = los[run[first]] + at[first] - offset
    return docs[run[first]], start, start + (last - first) + DEPTH


def sorted_groups(reps: DataFrame) -> DataFrame:
    """Spans of repeated windows among the runs of one anchor: rows (kg, doc, lo,
    bytes). A group has ``GROUP_RUNS`` runs at most."""

    def run(batches):
        held: list[tuple] = []

        def spans(rows):
            # the same document once more gives the same runs
            rows = [r for k, r in enumerate(rows) if not k or r[:3] != rows[k - 1][:3]]
            cols = list(zip(*rows))
            out = spans_in(*[np.array(c, np.int64) for c in cols[:3]], list(cols[3]))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc", "start", "end"])

        for batch in batches:
            held += zip(*[c.to_pylist() for c in batch.columns])
            if len(held) >= SORT_RUNS:
                cut = len(held) - 1  # the last bucket may go on in the next batch
                while cut and held[cut - 1][0] == held[-1][0]:
                    cut -= 1
                done = 0
                while done < cut:
                    end = min(done + SORT_RUNS, cut)
                    while end < cut and held[end][0] == held[end - 1][0]:
                        end += 1
                    yield spans(held[done:end])
                    done = end
                held = held[cut:]
        if held:
            yield spans(held)

    together = reps.repartition("kg").sortWithinPartitions("kg", "doc", "lo")
    return together.select("kg", "doc", "lo", "bytes").mapInArrow(run, "doc bigint, start bigint, end bigint")


def windows(reps: DataFrame) -> DataFrame:
    """kg, w (the DEPTH bytes), doc, p of each suffix of runs (kg, doc, lo, bytes)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                data, start, own = suffixes(part.column(3).to_pylist())
                offset = np.cumsum([0, *[len(b) for b in part.column(3).to_pylist()]])[own]
                kg, doc, lo = (part.column(k).to_numpy()[own] for k in range(3))
                flat = np.lib.stride_tricks.sliding_window_view(data, DEPTH)[start].tobytes()
                w = pa.FixedSizeBinaryArray.from_buffers(pa.binary(DEPTH), len(start), [None, pa.py_buffer(flat)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(kg), w, pa.array(doc), pa.array(lo + start - offset)], names=["kg", "w", "doc", "p"])

    return reps.select("kg", "doc", "lo", "bytes").mapInArrow(run, "kg bigint, w binary, doc bigint, p bigint")


def radix_passes(cut: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, start, end) of the repeats among suffixes (kg, w, doc, p) of large
    buckets: a pass over all tasks for each of ``DEPTHS``."""
    for k, depth in enumerate(DEPTHS):
        digit = F.substring("w", 1, depth) if depth < DEPTH else F.col("w")
        cut = cut.withColumn("d", digit)
        groups = cut.groupBy("kg", "d").agg(F.min(F.struct("doc", "p")).alias("first"), F.count("*").alias("m")).where("m > 1")
        groups = scratch.keep(groups, f"groups-{k}")  # so that the join below reads plain shuffles, which can be split
        if depth < DEPTH:
            cut = scratch.keep(cut.join(groups.select("kg", "d"), ["kg", "d"], "left_semi").drop("d"), f"pass-{k}")
            if k:
                scratch.drop(f"pass-{k - 1}")
    first = groups.select("kg", "d", F.col("first.doc").alias("d0"), F.col("first.p").alias("p0"))
    again = cut.join(first, ["kg", "d"]).where("doc <> d0 or p <> p0")
    return again.select("doc", F.col("p").alias("start"), (F.col("p") + DEPTH).alias("end"))


def repeated_spans(docs: DataFrame, scratch: Scratch, group_runs: int = GROUP_RUNS) -> DataFrame:
    """(doc, start, end) byte spans that repeat an earlier window; they overlap."""
    known = docs.where("doc_id is not null")
    repeated = scratch.keep(anchors(known, True).groupBy("kg").count().where("count > 1").select("kg"), "anchors")
    members = scratch.keep(anchors(known, False).join(repeated, "kg", "left_semi"), "runs")
    scratch.drop("anchors")
    first = F.min(F.struct("doc", "lo", "n")).alias("first")
    classes = scratch.keep(members.where("not own").groupBy("kg", "rh").agg(first, F.count("*").alias("m")), "classes")
    span = ["doc", F.col("lo").alias("start"), (F.col("lo") + F.col("n") + (DEPTH - 1)).alias("end")]
    copies = members.where("not own").join(classes.where("m > 1").select("kg", "rh", F.col("first.doc").alias("d0"), F.col("first.lo").alias("l0")), ["kg", "rh"])
    copies = copies.where("doc <> d0 or lo <> l0").select(*span).unionByName(members.where("own").select(*span))
    shared = classes.groupBy("kg").count().where("count > 1").select("kg", (F.col("count") > group_runs).alias("large"))
    asked = classes.join(shared, "kg").select(F.col("first.doc").alias("doc"), F.struct("kg", "large", F.col("first.lo").alias("lo"), F.col("first.n").alias("n")).alias("r"))
    asked = asked.groupBy("doc").agg(F.collect_list("r").alias("asked"))  # of one document, no longer than it
    reps = scratch.keep(contexts(known.join(asked, known.doc_id == asked.doc).select("doc", "text", "asked")), "contexts")
    spans = copies.unionByName(sorted_groups(reps.where("not large")))
    large = reps.where("large")
    if large.isEmpty():
        return spans
    # repeated rows of one document give the same suffixes
    return spans.unionByName(radix_passes(windows(large.dropDuplicates(["kg", "doc", "lo"])), scratch))


def deduplicated(docs: DataFrame, texts: bool = False, group_runs: int = GROUP_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of (doc_id, text), and
    with ``texts`` the bytes that stay."""
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    spans = repeated_spans(docs, scratch, group_runs).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = scratch.keep(spans, "spans")
    scratch.drop("runs", "classes", "contexts", *(f"{name}-{k}" for name in ("pass", "groups") for k in range(len(DEPTHS))))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + texts]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows, part = [], batch.slice(at, 256)
                lists = part.column(2)
                starts, ends = (x.to_pylist() for x in lists.flatten().flatten())
                count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                for doc_id, text, lo, hi in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), (np.cumsum(count) - count).tolist(), np.cumsum(count).tolist()):
                    raw = (text or "").encode()
                    kept, last, removed, n = [], 0, 0, 0
                    for a, b in merged(list(zip(starts[lo:hi], ends[lo:hi]))):
                        kept.append(raw[last:a])
                        last, removed, n = b, removed + b - a, n + 1
                    kept.append(raw[last:])
                    kept = b"".join(kept)
                    rows.append((doc_id, len(raw), removed, n, hashlib.sha256(kept).hexdigest(), kept)[: len(names)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    both = docs.join(spans, docs.doc_id == spans.doc, "left").select("doc_id", "text", "spans")
    return both.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * texts)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(id_and_text(spark.read.parquet(f"{sf_dir}/documents.parquet")))
