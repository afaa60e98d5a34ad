"""Operator 5: near duplicates by SimHash, linked through popcount segments.

A fingerprint's 64 bits are 32 segments of two; its embedding is the segments'
bit counts, kept in unary (0: 00, 1: 01, 2: 11) so that the Manhattan distance
of two embeddings is the popcount of their exclusive or. That distance is never
above the Hamming distance of the fingerprints, so a range join of radius 4 on
the embedding loses no link. The grid: the segments form six groups; four units
of distance touch four groups at most, so two embeddings in range agree in two
groups at least, that is, they share the cell of one of the 15 pairs of groups.
Within a cell the Manhattan bound is tested first, then the exact distance.

Only distinct fingerprints are joined; copies follow their fingerprint. A cell
gives the edges of a spanning forest of its links, not all pairs. A cell of more
than ``CELL_ROWS`` fingerprints is cut finer by the bits themselves: links differ
in four bits at most, so they agree in all bits of some pair of groups, and then
in one of ``PIECES`` pieces of the other bits. A finer cell fixes about 30 bits;
one that is still too large is cut into chunks, and each pair of chunks is a
task of its own, so no task holds more than two chunks.

Defined results: a null or empty text has fingerprint zero and links like any
other; a row with a null doc_id gets its fingerprint but a null component and
links nothing; repeated rows come back each; an empty table gives no rows; other
columns are unread. Where one document of each group stays (``one_of_each``) rows
are nodes of their own, so two texts under one doc_id are told apart: of a group
the row with the smallest doc_id stays (then by a hash of the text), one of rows
equal in both; rows without a doc_id all stay; all other columns, of any names,
are kept.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, id_and_text, quoted
from .components import smallest_reachable

SEED, SHINGLE, NEAR = 42, 4, 4
CELL_ROWS = 4096
#: Bit ranges of the six groups of segments.
GROUPS = ((0, 10), (10, 20), (20, 30), (30, 40), (40, 52), (52, 64))
PIECES = NEAR + 1


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned integer."""
    import xxhash

    digest = xxhash.xxh64_digest
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= SHINGLE:
        return int.from_bytes(digest(whole, SEED), "big")
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    cuts = list(zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist()))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(cuts), 1 << 16):
        joined = b"".join([digest(whole[a:b], SEED) for a, b in cuts[at : at + (1 << 16)]])
        counts += np.unpackbits(np.frombuffer(joined, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(cuts)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the bits as a signed bigint) of (doc_id, text)."""

    def build():
        return lambda ids, texts: {"doc_id": ids, "fp": [signed(fingerprint(t)) for t in texts]}

    return arrow_map(docs, "doc_id bigint, fp bigint", build)


def embedding(fp: Column) -> Column:
    """Two-bit segments' counts in unary."""
    low = F.lit(0x5555555555555555)
    shifted = F.shiftrightunsigned(fp, 1)
    both = F.shiftleft(fp.bitwiseAND(shifted).bitwiseAND(low), 1)
    return both.bitwiseOR(fp.bitwiseOR(shifted).bitwiseAND(low))


def embedded(fp: np.ndarray) -> np.ndarray:
    low = np.uint64(0x5555555555555555)
    half = fp >> np.uint64(1)
    return ((fp & half & low) << np.uint64(1)) | ((fp | half) & low)


def near(fp: np.ndarray, emb: np.ndarray, other_fp, other_emb) -> np.ndarray:
    out = np.bitwise_count(emb ^ other_emb) <= NEAR
    out[out] = np.bitwise_count((fp ^ other_fp)[out] if np.ndim(other_fp) == 0 else fp[out] ^ other_fp[out]) <= NEAR
    return out


def cell_forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """Edges (positions) of a spanning forest of one cell's links: breadth
    first, each reached fingerprint against those not reached yet."""
    emb, edges = embedded(fp), []
    rest = np.arange(len(fp))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            hit = near(fp[rest], emb[rest], fp[at], emb[at])
            if hit.any():
                found = rest[hit]
                edges += [(int(at), int(x)) for x in found]
                queue += found.tolist()
                rest = rest[~hit]
    return edges


SMALL = 24


def forest(cell: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of all cells; rows come sorted by cell number."""
    lo = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    size = np.diff(np.concatenate((lo, [len(cell)])))
    left, right = [], []
    for a, n in zip(lo[size > SMALL].tolist(), size[size > SMALL].tolist()):
        for x, y in cell_forest(fp[a : a + n]):
            left.append(a + x)
            right.append(a + y)
    small = np.repeat((size > 1) & (size <= SMALL), size)
    rows = np.flatnonzero(small)
    emb = embedded(fp)
    parent: dict[int, int] = {}

    def root(x):
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    step = 1
    while len(rows):
        rows = rows[rows + step < len(cell)]
        rows = rows[cell[rows] == cell[rows + step]]
        hit = rows[near(fp[rows], emb[rows], fp[rows + step], emb[rows + step])] if len(rows) else rows
        for a in hit.tolist():
            x, y = root(a), root(a + step)
            if x != y:
                parent[max(x, y)] = min(x, y)
                left.append(a)
                right.append(a + step)
        step += 1
    return np.array(left, np.int64), np.array(right, np.int64)


def cell_edges(cells: DataFrame) -> DataFrame:
    """Edges (a, b) of representatives from rows (c1, c2, c3, fp, rep) that
    stand together and sorted by cell."""

    def run(batches):
        held: pa.Table | None = None

        def edges(part: pa.Table):
            keys = [part.column(k).to_numpy() for k in range(3)]
            change = np.zeros(len(keys[0]), bool)
            for k in keys:
                change[1:] |= k[1:] != k[:-1]
            fp = part.column(3).to_numpy().view(np.uint64)
            rep = part.column(4).to_numpy()
            a, b = forest(np.cumsum(change), fp)
            return pa.RecordBatch.from_arrays([pa.array(rep[a], pa.int64()), pa.array(rep[b], pa.int64())], names=["a", "b"])

        for batch in batches:
            part = pa.Table.from_batches([batch])
            if held is not None:
                part = pa.concat_tables([held, part]).combine_chunks()
            if not part.num_rows:
                continue
            # the last cell may go on in the next batch
            last = [part.column(k)[-1].as_py() for k in range(3)]
            same = np.logical_and.reduce([part.column(k).to_numpy() == last[k] for k in range(3)])
            first = int(np.argmax(same))
            held = part.slice(first)
            if first:
                yield edges(part.slice(0, first))
        if held is not None and held.num_rows:
            yield edges(held)

    return cells.select("c1", "c2", "c3", "fp", "rep").mapInArrow(run, "a bigint, b bigint")


def bits(places) -> int:
    return signed(sum(1 << k for k in places))


def grid() -> list[tuple[int, int, list[int]]]:
    """(number, mask, masks of the finer cells) of each pair of groups."""
    out = []
    for t, pair in enumerate(combinations(GROUPS, 2)):
        own = {k for a, b in pair for k in range(a, b)}
        rest = [k for k in range(64) if k not in own]
        out.append((t, bits(own), [bits(own | set(rest[j::PIECES])) for j in range(PIECES)]))
    return out


def links(distinct: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges between representatives of (fp, rep), fp distinct."""
    emb = distinct.withColumn("emb", embedding(F.col("fp")))
    coarse = F.array(*[F.struct(F.lit(t).alias("c1"), F.col("emb").bitwiseAND(F.lit(m)).alias("c2")) for t, m, _ in grid()])
    cells = emb.select("fp", "rep", F.explode(coarse).alias("c")).select("c.c1", "c.c2", "fp", "rep")
    full = cells.groupBy("c1", "c2").count().where(F.col("count") > cell_rows).select("c1", "c2", F.lit(True).alias("full"))
    cells = cells.join(full, ["c1", "c2"], "left")
    fine = F.array(*[F.struct(F.lit(100 + 10 * t + j).alias("c1"), F.col("fp").bitwiseAND(F.lit(m)).alias("c2")) for t, _, masks in grid() for j, m in enumerate(masks)])
    own = F.slice(fine, F.col("c1") * PIECES + 1, F.lit(PIECES))
    cells = cells.select("fp", "rep", "full", F.explode(F.when(F.col("full"), own).otherwise(F.array(F.struct("c1", "c2")))).alias("c"))
    cells = cells.select("c.c1", "c.c2", "fp", "rep", "full")
    large = cells.where("full").groupBy("c1", "c2").count().where(F.col("count") > cell_rows).select("c1", "c2", F.ceil(F.col("count") / cell_rows).cast("int").alias("chunks"))
    cells = cells.join(large, ["c1", "c2"], "left")
    part = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.least(part, k) * F.col("chunks") + F.greatest(part, k))
    cells = cells.withColumn("c3", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(-1))).otherwise(pairs)))
    return cell_edges(cells.repartition("c1", "c2", "c3").sortWithinPartitions("c1", "c2", "c3"))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id of (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs), "fingerprints")
    distinct = scratch.keep(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    edges = scratch.keep(links(distinct).distinct(), "links")
    groups = smallest_reachable(edges)
    scratch.drop("links")
    by_print = distinct.join(groups, distinct.rep == groups.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = prints.join(by_print, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """All columns of the rows that stay, one of each group of near duplicates.

    The texts are shuffled once, by id and hash, to meet the keys that stay.
    """
    scratch = Scratch(docs.sparkSession, "one-of-each")
    plain = id_and_text(docs)

    def build():
        return lambda ids, hashes, texts: {"doc_id": ids, "hash": hashes, "fp": [signed(fingerprint(t)) for t in texts]}

    prints = arrow_map(plain.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("hash"), "text"), "doc_id bigint, hash bigint, fp bigint", build)
    distinct = scratch.keep(prints.groupBy("fp").agg(F.min(F.struct("doc_id", "hash")).alias("k")), "distinct")
    edges = scratch.keep(links(distinct.select("fp", F.col("fp").alias("rep"))).distinct(), "links")
    groups = smallest_reachable(edges)
    scratch.drop("links")
    each = distinct.join(groups, distinct.fp == groups.node, "left").groupBy(F.coalesce("component", "fp").alias("g")).agg(F.min("k").alias("k"))
    stay = scratch.keep(each.select(F.col("k.doc_id").alias("s_id"), F.col("k.hash").alias("s_hash")).distinct(), "stay")
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("k_id"),
                       F.xxhash64(F.col("text").cast("string")).alias("k_hash"))
    met = rows.join(stay, (F.col("k_id") == F.col("s_id")) & (F.col("k_hash") == F.col("s_hash")), "left_semi").dropDuplicates(["k_id", "k_hash"])
    return met.unionByName(rows.where("k_id is null")).select("row.*")


def op5_simhash_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(id_and_text(spark.read.parquet(f"{sf_dir}/documents.parquet")))
