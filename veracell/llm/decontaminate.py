"""Operator 6: benchmark decontamination with an FM-index per training shard.

Each task gathers documents into shards of at most ``SHARD_WORDS`` words (one
longer document is a shard of its own), numbers their words by the benchmark's
vocabulary, and builds an FM-index of the shard. Words that no benchmark item
has can be in no match, so a run of them, like the end of a document, is one
separator. All distinct test phrases are searched backward through the wavelet
matrix together, their occurrences located by sampled suffix positions, and the
word spans merged. No row is shuffled.

The benchmark is cut into blocks of at most ``BLOCK_BYTES`` of text by tasks that
write each block's phrases as a file in the shared folder; the driver sees the
files' names only. Each shard is searched for one block after another, a worker
holds one block at a time, and spans and items are brought together row by row.

Defined results: null, empty and wordless texts have no words and are clean;
wordless items match nothing; an item of fewer than 8 words is one phrase;
repeated rows are judged each; an empty benchmark leaves all clean; an empty
table gives no rows; other columns are unread.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, id_and_text, map_text, opened
from .fm_index import FmIndex

WINDOW = 8
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 16 << 20
SEPARATOR = 1
#: Letters, digits and bytes of other alphabets; capitals made small; all else a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class Phrases:
    """A block of benchmark items: vocabulary, distinct phrases, their items."""

    def __init__(self, items: list[tuple[str, str | None]]):
        self.items = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        distinct: dict[tuple[int, ...], set[int]] = {}
        number = self.vocabulary
        for k, (_, text) in enumerate(items):
            ids = [number.setdefault(w, len(number) + SEPARATOR + 1) for w in words(text)]
            for at in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
                distinct.setdefault(tuple(ids[at : at + WINDOW]), set()).add(k)
        self.by_length: list[tuple[np.ndarray, list[tuple[int, ...]]]] = []
        for n in sorted({len(p) for p in distinct}):
            own = [p for p in distinct if len(p) == n]
            self.by_length.append((np.array(own, np.int64), [tuple(sorted(distinct[p])) for p in own]))


def shard_hits(docs: list[list[bytes]], phrases: Phrases) -> tuple[list[np.ndarray], list[list[str]]]:
    """For each document its merged (start, end) word spans and its items."""
    sizes = np.array([len(d) for d in docs], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    spans, items = [np.empty((0, 2), np.int64)] * len(docs), [[] for _ in docs]
    if not starts[-1] or not phrases.by_length:
        return spans, items
    get, ids = phrases.vocabulary.get, np.full(starts[-1] + len(docs), SEPARATOR, np.int64)
    origin = np.full(len(ids), -1, np.int64)
    for k, d in enumerate(docs):
        a = starts[k] + k
        ids[a : a + len(d)] = np.fromiter(map(get, d, repeat(SEPARATOR)), np.int64, len(d))
        origin[a : a + len(d)] = np.arange(starts[k], starts[k + 1])
    keep = (ids != SEPARATOR) | np.concatenate(([True], ids[:-1] != SEPARATOR))
    ids, origin = ids[keep], origin[keep]
    index = FmIndex(ids)
    edge = np.zeros(starts[-1] + 1, np.int64)
    pairs = []
    for patterns, owners in phrases.by_length:
        lo, hi = index.search(patterns)
        n = np.maximum(hi - lo, 0)
        found = np.flatnonzero(n)
        if not len(found):
            continue
        rows = np.repeat(lo[found] - np.cumsum(n[found]) + n[found], n[found]) + np.arange(n.sum())
        at = origin[index.locate(rows)]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + patterns.shape[1], -1)
        which = np.repeat(found, n[found])
        doc = np.searchsorted(starts, at, side="right") - 1
        pairs += [(d, i) for d, p in np.unique(np.stack((doc, which)), axis=1).T.tolist() for i in owners[p]]
    if not pairs:
        return spans, items
    for d, i in set(pairs):
        items[d].append(phrases.items[i])
    hit = np.concatenate(([0], (np.cumsum(edge)[:-1] > 0).astype(np.int8), [0]))
    for d in {d for d, _ in pairs}:
        own = np.concatenate(([0], hit[starts[d] + 1 : starts[d + 1] + 1], [0]))
        change = np.flatnonzero(np.diff(own))
        spans[d] = change.reshape(-1, 2)
        items[d].sort()
    return spans, items


def shards(batches, n_cols: int, shard_words: int):
    """(other columns, texts, word lists) of shard after shard."""
    held, texts, cut, n = [[] for _ in range(n_cols)], [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            cols = [part.column(k).to_pylist() for k in range(n_cols)]
            for k, text in enumerate(part.column(n_cols).to_pylist()):
                w = words(text)
                if n and n + len(w) > shard_words:
                    yield held, texts, cut
                    held, texts, cut, n = [[] for _ in range(n_cols)], [], [], 0
                for h, c in zip(held, cols):
                    h.append(c[k])
                texts.append(text)
                cut.append(w)
                n += len(w)
    if cut:
        yield held, texts, cut


def blocks(benchmark: DataFrame, scratch: Scratch, block_bytes: int = BLOCK_BYTES) -> list[str]:
    """Names of the files with the benchmark's (item_id, text) in blocks. A longer
    item is cut where the pieces share ``WINDOW`` - 1 words, so no window is lost."""
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    folder = f"{scratch.folder}/blocks"

    def items(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(text or "") * 4 <= block_bytes:
                    yield item or "", text
                    continue
                cut, step = words(text), max(1, block_bytes // 16)
                for at in range(0, max(1, len(cut) - WINDOW + 1), step):
                    yield item or "", b" ".join(cut[at : at + step + WINDOW - 1]).decode()

    def store(held) -> pa.RecordBatch:
        uri = f"{folder}/{uuid.uuid4().hex}"
        with opened(uri, "w") as out:
            out.write(pickle.dumps(Phrases(held)))
        return pa.RecordBatch.from_pydict({"path": [uri]})

    def run(batches):
        held, size = [], 0
        for item, text in items(batches):
            n = len((text or "").encode())
            if held and size + n > block_bytes:
                yield store(held)
                held, size = [], 0
            held.append((item, text))
            size += n
        if held:
            yield store(held)

    return sorted(r.path for r in rows.coalesce(n).mapInArrow(run, "path string").collect())


_HELD: dict[str, Phrases] = {}


def block(uri: str) -> Phrases:
    """A block's phrases; a worker keeps the last one it read."""
    if uri not in _HELD:
        _HELD.clear()
        with opened(uri, "r") as f:
            _HELD[uri] = pickle.loads(f.read())
    return _HELD[uri]


def spans_of(docs: DataFrame, paths: list[str], shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, spans (flat: start, end, ...) and items of (doc_id, text), row by row; those of several blocks follow each other."""
    schema = "doc_id bigint, n_words bigint, spans array<bigint>, items array<string>"

    def run(batches):
        for (ids,), _, cut in shards(batches, 1, shard_words):
            spans, items = [[] for _ in cut], [[] for _ in cut]
            for path in paths:
                for k, (s, i) in enumerate(zip(*shard_hits(cut, block(path)))):
                    spans[k] += s.ravel().tolist()
                    items[k] += i
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(c) for c in cut], pa.int64()),
                 pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "n_words", "spans", "items"])

    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    every = spans_of(docs, blocks(benchmark, Scratch(docs.sparkSession, "benchmark"), block_bytes), shard_words)

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, n, flat, items in zip(*[c.to_pylist() for c in batch.columns]):
                spans = merged(flat)
                items = sorted(set(items))
                rows.append((doc_id, n, sum(b - a for a, b in spans), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(),
                             len(items) >= 2, ",".join(f"{a}:{b}" for a, b in spans)))
            cols = list(zip(*rows)) or [[]] * 7
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    return every.mapInArrow(run, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans string")


def merged(flat: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(flat[::2], flat[1::2])):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from the first to the last word of each span."""
    import re

    at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join(out) + text[last:]


def cleaned(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs``, every benchmark passage cut out of the text;
    block after block, so that spans of two blocks that meet are both cut."""
    paths = blocks(benchmark, Scratch(docs.sparkSession, "benchmark"), block_bytes)

    def clean(part: list[str | None], cut: list[list[bytes]]) -> list[str | None]:
        found: dict[int, list[int]] = {}
        for path in paths:
            for k, s in enumerate(shard_hits(cut, block(path))[0]):
                if len(s):
                    found.setdefault(k, []).extend(s.ravel().tolist())
        return [without(t, merged(found[k])) if k in found else t for k, t in enumerate(part)]

    def change(texts: pa.Array) -> list[str | None]:
        done, part, cut, n = [], [], [], 0
        for scalar in texts:
            text = scalar.as_py()
            w = words(text)
            if n and n + len(w) > shard_words:
                done += clean(part, cut)
                part, cut, n = [], [], 0
            part.append(text)
            cut.append(w)
            n += len(w)
        return done + clean(part, cut)

    return map_text(docs, text_col, change)


def op6_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_and_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
