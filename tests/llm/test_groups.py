import random

import numpy as np
import pytest

import brute
from veracell.llm import chat, components, decontaminate, fm_index, simhash, suffix_dedup
from veracell.llm.common import Scratch, id_and_text


def test_fingerprints_and_components(docs, table, texts, rowless):
    words = [f"t{k}" for k in range(400)]
    r, near = random.Random(3), dict(texts)
    for k in range(20, 40):
        w = list(words)
        w[r.randrange(400)] = "changed"
        near[k] = " ".join(w)
    rows = {x.doc_id: x for x in simhash.near_groups(id_and_text(table(list(near.items())))).collect()}
    prints = {d: brute.simhash(t) for d, t in near.items()}
    want = brute.components(prints)
    assert {d: int(x.fingerprint, 16) for d, x in rows.items()} == prints
    assert {d: x.component_id for d, x in rows.items()} == want
    assert want[39] == 20 and want[2] == want[3] == want[4] == 2
    assert simhash.near_groups(id_and_text(rowless)).count() == 0


def test_null_ids_and_repeats(table):
    rows = simhash.near_groups(id_and_text(table([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (9, "a b c d")]))).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (5, 5), (5, 5), (9, 5)]
    stay = simhash.one_of_each(table([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (9, "a b c d"), (8, "z")]))
    assert sorted((r.doc_id or 0) for r in stay.collect()) == [0, 5, 8] and "a.b" in stay.columns


@pytest.mark.parametrize("cell_rows", [3, 1 << 12])
def test_cells_lose_no_link(spark, cell_rows):
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(4)]
    prints = {b for b in base}
    for b in base:
        for _ in range(60):
            x = b
            for _ in range(r.randint(1, 5)):
                x ^= 1 << r.randrange(64)
            prints.add(x)
    rows = {k: p for k, p in enumerate(sorted(prints))}
    df = spark.createDataFrame([(simhash.signed(p), k) for k, p in rows.items()], "fp bigint, rep bigint")
    got = {x.node: x.component for x in components.smallest_reachable(simhash.links(df, cell_rows)).collect()}
    want = brute.components(rows)
    assert {k: got.get(k, k) for k in rows} == want


def test_full_cells_of_equal_bits_are_cut_finer(spark):
    """Fingerprints that differ in a few low bits only: one cell of the grid holds all."""
    r = random.Random(4)
    prints = sorted({(0x123456789ABC << 16) | r.getrandbits(16) for _ in range(300)})
    df = spark.createDataFrame([(simhash.signed(p), k) for k, p in enumerate(prints)], "fp bigint, rep bigint")
    got = {x.node: x.component for x in components.smallest_reachable(simhash.links(df, 8)).collect()}
    assert {k: got.get(k, k) for k in range(len(prints))} == brute.components(dict(enumerate(prints)))


def test_rows_stay_by_row_whatever_their_id_and_columns(spark):
    rows = [(5, "one two three four five"), (5, "quite other words are in this text"), (6, "one two three four five"), (None, "one two three four five"),
            (None, "a text without id that stays"), (7, "twice the same row here"), (7, "twice the same row here")]
    df = spark.createDataFrame([(i, t, k, "x") for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, stays int, `a``b` string")
    out = simhash.one_of_each(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted(
        [("5", rows[0][1]), ("5", rows[1][1]), ("None", rows[3][1]), ("None", rows[4][1]), ("7", rows[5][1])])
    assert simhash.one_of_each(df.limit(0)).count() == 0


def test_very_long_texts(table):
    r = random.Random(5)
    long = " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(60_000))
    passage = "jumps over the lazy dog while seven wise wizards mix a very potent brew"
    docs = table([(1, long + " " + passage), (2, long), (3, "short one")])
    rows = {x.doc_id: x for x in simhash.near_groups(id_and_text(docs)).collect()}
    assert int(rows[1].fingerprint, 16) == brute.simhash(long + " " + passage) and rows[1].component_id == rows[2].component_id == 1
    cut = {x.doc_id: x for x in suffix_dedup.deduplicated(id_and_text(docs)).collect()}
    assert cut[2].n_removed == len(long) and cut[1].n_removed == 0
    bench = docs.sparkSession.createDataFrame([("b", passage)], "item_id string, text string")
    hit = {x.doc_id: x for x in decontaminate.contamination(id_and_text(docs), bench).collect()}
    assert hit[1].n_hit == 14 and hit[2].n_hit == 0 and hit[1].n_words == 60_014


def test_the_embedding_is_a_lower_bound():
    r = np.random.RandomState(1)
    a, b = (r.randint(0, 1 << 62, 5000, dtype=np.int64).view(np.uint64) for _ in range(2))
    assert (np.bitwise_count(simhash.embedded(a) ^ simhash.embedded(b)) <= np.bitwise_count(a ^ b)).all()


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 400), (400, 400), (None, 1)], "a bigint, b bigint")
    got = {r.node: r.component for r in components.smallest_reachable(e).collect()}
    assert all(got[k] == 0 for k in range(1, 201)) and got[500] == 400


@pytest.mark.parametrize("group_runs", [1, 1 << 14])
def test_repeated_bytes(table, texts, rowless, group_runs):
    r, more = random.Random(8), dict(texts)
    body = "".join(r.choice("abcd ") for _ in range(600))
    for k in range(30, 60):
        a, n = r.randrange(400), r.randint(80, 400)
        more[k] = "".join(r.choice("efgh ") for _ in range(r.randrange(150))) + body[a : a + n] + "ü" * r.randrange(3)
    more[61] = "ab" * 300
    rows = {x.doc_id: x for x in suffix_dedup.deduplicated(id_and_text(table(list(more.items()))), group_runs=group_runs).collect()}
    for d, want in brute.repeated_bytes(more).items():
        x = rows[d]
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == want, d
    assert suffix_dedup.deduplicated(id_and_text(rowless)).count() == 0


def test_runs_of_pieces_hashed_together():
    r = random.Random(4)
    texts = ["".join(r.choice("abé ") for _ in range(r.choice([1, 60, 99, 100, 101, 300, 5000]))) for _ in range(400)]
    groups, depth, gram = list(suffix_dedup.pieces(range(400), texts)), suffix_dedup.DEPTH, suffix_dedup.GRAM
    assert all(len(g) == 1 or sum(len(p) for _, _, p in g) <= 1 << 17 for g in groups)  # arrays of eight bytes each that a cache holds
    assert [d for g in groups for d, _, _ in g] == list(range(400))
    parts = [p for _, _, p in groups[0]][:40]
    sizes = np.array(list(map(len, parts)), np.int64)
    starts = np.cumsum(sizes) - sizes
    *found, hashes = suffix_dedup.runs(np.frombuffer(b"".join(parts), np.uint8), starts, sizes)
    want, high = [], (hashes >> np.uint64(26)).tolist()
    for k, (a, n) in enumerate(zip(starts.tolist(), sizes.tolist())):
        for lo in range(a, a + n - depth + 1):
            anchor = min(range(lo, lo + depth - gram + 1), key=lambda at: (high[at], at))
            if want and want[-1][0] == k and want[-1][3] == anchor:
                want[-1][2] += 1
            else:
                want.append([k, lo, 1, anchor])
    assert [list(x) for x in zip(*[c.tolist() for c in found])] == want


def test_long_texts_are_cut_into_pieces(table, monkeypatch):
    r = random.Random(2)
    t = "".join(r.choice("abcdefgh") for _ in range(1500))
    monkeypatch.setattr(suffix_dedup, "PIECE", 256)
    parts = [p for g in suffix_dedup.pieces([1], [t]) for p in g]
    starts = [o + k for _, o, b in parts for k in range(len(b) - 99)]
    assert sorted(starts) == list(range(1401)) and len(parts) > 3


@pytest.mark.parametrize("n", [1, 5, 40, 99, 100])
def test_tables_of_short_texts_only(table, n):
    rows = suffix_dedup.deduplicated(id_and_text(table([(1, "x" * n), (2, "x" * n)]))).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(1, 0), (2, 100 * (n == 100))]


def test_rows_without_id_or_twice(table):
    r = random.Random(1)
    t = "".join(r.choice("abcdefgh ") for _ in range(300))
    rows = suffix_dedup.deduplicated(id_and_text(table([(None, t), (3, t), (3, t), (4, t), (5, "z" + t[50:] + "z"), (5, "z" + t[50:] + "z")]))).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (3, 0), (3, 0), (4, 300), (5, 250), (5, 250)]


def test_fm_index_against_search():
    r = random.Random(3)
    for _ in range(150):
        n = r.randint(1, 60)
        t = np.array([r.randint(1, r.choice([1, 2, 4])) for _ in range(n)])
        whole = [*t.tolist(), 0]
        assert list(fm_index.suffix_order(np.array(whole))) == sorted(range(n + 1), key=lambda i: whole[i:])
        f = fm_index.FmIndex(t)
        for size in (1, 2, 5):
            p = np.array([[r.randint(1, 5) for _ in range(size)] for _ in range(5)])
            for q, lo, hi in zip(p.tolist(), *f.search(p)):
                want = [k for k in range(n - size + 1) if t[k : k + size].tolist() == q]
                assert sorted(f.locate(np.arange(lo, max(lo, hi))).tolist()) == want


@pytest.mark.parametrize("block_bytes,shard_words", [(1 << 20, 1 << 20), (60, 40)])
def test_contamination(spark, table, texts, rowless, block_bytes, shard_words):
    bench = {"7": "jumps over the lazy dog while seven wise wizards mix a very potent brew", "12": "The LAZY dog, while: seven wise (wizards) mix a very potent", "3": "straße", "x": " .. ", "n": None, "w": " ".join(f"w{k}" for k in range(690, 699))}
    b = spark.createDataFrame(list(bench.items()), "item_id string, text string")
    rows = {r.doc_id: r for r in decontaminate.contamination(id_and_text(table(list(texts.items()))), b, block_bytes, shard_words).collect()}
    for d, want in brute.contamination(texts, bench).items():
        x = rows[d]
        assert (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) == want, d
    assert rows[1].contaminated and not rows[6].contaminated and rows[9].n_items == 1
    assert decontaminate.contamination(id_and_text(rowless), b).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(id_and_text(table([(1, "a b")])), b.limit(0)).collect()} == {0}
    out = {r.doc_id: r for r in decontaminate.cleaned(table(list(texts.items())), b, shard_words=shard_words, block_bytes=block_bytes).collect()}
    assert "lazy" not in out[1].text and out[6].text == texts[6] and out[2].text is None and out[1].kg == 1


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_contamination_judges_each_row_of_a_repeated_id(spark, table, texts, block_bytes):
    bench = {"7": "jumps over the lazy dog while seven wise wizards mix a very potent brew", "3": "straße", "w": " ".join(f"w{k}" for k in range(690, 699))}
    b = spark.createDataFrame(list(bench.items()), "item_id string, text string")
    assert (len(decontaminate.blocks(b, Scratch(spark, "test"), block_bytes)) > 1) == (block_bytes == 60)
    one, two = "say jumps over the lazy dog while seven wise wizards mix a very potent brew", "straße"
    rows = [(None, one), (None, "clean"), (None, None), (5, one), (5, two), (5, two), (5, f"{one} {two}"), *texts.items()]
    want = brute.contamination({k: t for k, (_, t) in enumerate(rows)}, bench)
    got = decontaminate.contamination(id_and_text(table(rows)), b, block_bytes, 40).collect()
    assert sorted(str((x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated)) for x in got) == sorted(str((d, *want[k])) for k, (d, _) in enumerate(rows))


def render(rows):
    return "".join(r.segment for r in sorted(rows, key=lambda r: r.place))


def test_repair_is_cheapest():
    r = random.Random(1)
    for _ in range(300):
        roles = [r.choice([1, 2, 3, 2, 3, None]) for _ in range(r.randint(1, 6))]
        best = [10**9]

        def go(k, s, c):
            if c >= best[0]:
                return
            if k == len(roles):
                best[0] = c
                return
            for m in chat.moves(roles[k]):
                if m[0] == s:
                    go(k + 1, m[1], c + m[2])

        go(0, chat.START, 0)
        assert sum(m[2] for m in chat.repair(roles, [0, chat.FAR, chat.FAR, chat.FAR])) == best[0]


def test_formatted_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "assistant", "lead"), (2, 1, "user", "q"), (2, 2, "user", "more"), (3, 0, None, None), (None, 0, "user", "x"), (4, 0, "user", "same"), (4, 0, "user", "same")]
    df = spark.createDataFrame([(*x, "z") for x in rows], "conv_id bigint, turn bigint, role string, text string, action string")
    for chunk in (1, 2, 1024):
        got: dict = {}
        for r in chat.formatted(df, chunk).collect():
            got.setdefault(r.conv_id, []).append(r)
        assert render(got[1]) == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n"
        assert sum(r.cost for r in got[2]) == 4 and len(got[4]) == 2 and got[4][1].action == "merge" and len(got[None]) == 1
        for rs in got.values():
            roles = [x for r in sorted(rs, key=lambda r: r.place) for x in [*filter(None, r.inserted.split(",")), *([r.role] if r.action != "merge" else [])]]
            state = chat.START
            for x in map(chat.ROLES.index, roles):
                assert x in chat.NEXT[state]
                state = x
    assert chat.formatted(df.limit(0)).count() == 0


def whole_repairs(rows):
    """conv_id: rows (turn, place, role, action, inserted, cost, segment) of each conversation repaired in one piece."""
    out: dict = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0), (r is not None, r or ""), x or "", t, r) for c, t, r, x in rows if c == conv)
        moves = chat.repair([chat.role_number(r[4]) for r in own], [0, chat.FAR, chat.FAR, chat.FAR])
        out[conv] = [(r[3], k, chat.ROLES[m[1]], m[3], ",".join(chat.ROLES[i] for i in m[4]), m[2], chat.segment(m, r[2], k == len(own) - 1)) for k, (m, r) in enumerate(zip(moves, own))]
    return out


@pytest.mark.parametrize("chunk", [1, 3, 1024])
def test_chunks_are_repaired_as_one_piece(spark, chunk):
    r = random.Random(chunk)
    texts = ["banana", "apple", "zeta", "cherry", "mango", None, ""]
    rows = [(c, r.choice([0, 1, 2, None]) if c == 7 else k, r.choice(["user", "assistant", "system", "USER ", "tool", None, "user"]), r.choice(texts)) for c in range(1, 9) for k in range(r.randint(1, 40))]
    rows += [(None, None, "user", "same")] * 30 + [(5, 3, "assistant", t) for t in texts[:5]]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    got: dict = {}
    for x in chat.formatted(df, chunk).collect():
        got.setdefault(x.conv_id, []).append((x.turn, x.place, x.role, x.action, x.inserted, x.cost, x.segment))
    assert {c: sorted(v, key=lambda v: v[1]) for c, v in got.items()} == whole_repairs(rows)


def test_roles_first_in_a_new_application(tmp_path):
    """Workers that can't import this repository get its code from the operator."""
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parents[2]
    code = f"""
import os, sys
sys.path.insert(0, {str(repo)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from veracell.llm import chat
print("rows", chat.formatted(spark.createDataFrame([(1, 0, "user", "a")], "conv_id bigint, turn bigint, role string, text string")).count())
"""
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 1" in done.stdout, done.stderr[-2000:]
