import hashlib

import pytest

import brute
from veracell.llm import pair_bpe, token_counts, token_files, vocab
from veracell.llm.common import id_and_text, shared_dir, written

SAMPLE = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def real(spark, texts):
    rows = {r.doc_id + 100: r.text for r in spark.read.parquet(SAMPLE).collect()}
    return {**texts, **rows}


def read_back(spark, df, **k):
    folder = f"{shared_dir(spark)}/shards-test-{id(df)}"
    manifest = written(token_files.write_shards(df, folder, **k), "manifest")
    return manifest, token_files.read_shards(token_files.shard_starts(manifest))


def test_shards_hold_what_the_library_gives(spark, table, real):
    tok = vocab.hf("byte_bpe_50k.json")
    _, back = read_back(spark, id_and_text(table(list(real.items()))), frame_bytes=4096)
    rows, start = {r.doc_id: r for r in back.collect()}, 0
    for d in sorted(real):
        ids = tok.encode(real[d] or "", add_special_tokens=False).ids + [2]
        assert (rows[d].start, rows[d].n_tokens, rows[d].ids_crc32) == (start, len(ids), brute.crc(ids)), d
        start += len(ids)


def test_any_zstandard_reader_and_single_documents(spark, table, texts):
    import io

    import zstandard

    manifest, _ = read_back(spark, id_and_text(table(list(texts.items()))), frame_bytes=64)
    for r in manifest.collect():
        reader = token_files.ShardReader(r.path)
        whole = b"".join(reader.frame(k) for k in range(len(reader.frames)))
        raw = open(r.path.removeprefix("file://"), "rb").read()
        assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read() == whole
        assert [reader.document(k) for k in range(r.n_docs)] == list(reader)
    some = token_files.read_shards(token_files.shard_starts(manifest), frozenset({5, 10})).collect()
    assert {r.doc_id for r in some} == {5, 10}


def test_damage_is_found(spark, table, texts):
    manifest, _ = read_back(spark, id_and_text(table(list(texts.items()))))
    path = manifest.first().path.removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    raw[20] ^= 255
    open(path, "wb").write(raw)
    with pytest.raises(Exception):
        list(token_files.ShardReader("file://" + path))


def test_null_ids_repeats_and_no_rows(spark, table, rowless):
    _, back = read_back(spark, id_and_text(table([(None, "a b"), (1, "a"), (1, "a"), (None, None)])))
    rows = sorted(((r.doc_id is not None, r.start, r.n_tokens) for r in back.collect()))
    assert [x[0] for x in rows] == [False, False, True, True] and rows[0][1] == 0
    assert read_back(spark, id_and_text(rowless))[1].count() == 0


def test_counts(docs, table, rowless, real):
    sp = vocab.sp("piece_bpe_32k.model")
    got = {r.doc_id: r for r in token_counts.count_tokens(id_and_text(table(list(real.items())))).collect()}
    for d, t in real.items():
        n = len(sp.encode(t or ""))
        assert (got[d].n_bytes, got[d].n_tokens, got[d].over_limit) == (len((t or "").encode()), n, n > 4096), d
    assert token_counts.count_tokens(id_and_text(rowless)).count() == 0


@pytest.mark.parametrize("text", ["▁", "▁▁a ▁", "  ", " a", "a  b", "\n \n", "a b", "<s> </s>", "<0x41>", "é" * 50, "a" * 5000])
def test_counts_of_odd_spaces(text):
    c = token_counts.WholeTokenCounter("piece_bpe_32k.model")
    assert c.count([text]) == [len(c.sp.encode(text))]


def test_pair_index_codes_as_the_library(table, real, rowless):
    tok = vocab.hf("word_bpe_49k.json")
    out = pair_bpe.encode(id_and_text(table(list(real.items()))), ids=True)
    rows = {r.doc_id: r for r in out.collect()}
    back = {r.doc_id: r.text for r in pair_bpe.decode(out).collect()}
    for d, t in real.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        assert rows[d].ids == ids and rows[d].n_tokens == len(ids), d
        assert rows[d].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[d].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and back[d] == text
    assert pair_bpe.encode(id_and_text(rowless)).count() == 0


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(pair_bpe, "MEMO", 50)
    monkeypatch.setattr(token_files, "MEMO", 50)
    c, e = pair_bpe.PairCoder("word_bpe_49k.json"), token_files.PieceEncoder("byte_bpe_50k.json")
    for k in range(5):
        text = " ".join(f"word{k}x{j}" for j in range(40))
        assert " ".join(x[1] for x in c.encode([text])[0]) == " ".join(map(str, c.tok.encode(text, add_special_tokens=False).ids))
        assert e.encode([text])[0] == e._library([text])[0]
        assert len(c.memo) <= 90 and len(e.memo) <= 90


def test_plain_texts_are_cut_together_and_each_word_is_merged_once(monkeypatch):
    import pyarrow as pa

    e, merged = token_files.WordEncoder("byte_bpe_50k.json"), []
    model = e.pieces.model

    class Counting:
        def tokenize(self, word):
            merged.append(word)
            return model.tokenize(word)

    e.pieces.model = Counting()
    monkeypatch.setattr(e.pieces, "encode", lambda texts: pytest.fail("a text of its own") if texts else [])
    plain = ["", "x", "'s it's 've we're  they'll'd", "one two\n\n three \n", " Élan vital, 12 34ab!? ", "ends in \n", "don't 'tis rock'n'roll ' s''t"]
    for texts in (plain, plain[::-1] * 3, [t + "once" for t in plain]):
        assert e.encode(pa.array([None, *texts])) == [b"", *e.pieces._library(texts)]
    assert len(merged) == len(set(merged)) > 30


def test_cut_texts_code_as_the_library(monkeypatch):
    import random

    import pyarrow as pa

    monkeypatch.setattr(token_files, "KNOWN", 200)
    e, pick = token_files.WordEncoder("byte_bpe_50k.json"), random.Random(7)
    plain = ["'s", "'ve", "'ll", "'", "'r", "'S", " ", "  ", "\n", " \n", "\n ", "a", "re", "word", "é", "Ā", "ɏ", "1", "23", ".", "##", "don't", "s", "ll"]
    odd = [*plain, "×", "÷", "ɐ", "\t", "日本", "<|endoftext|>", "\xa0", "\x00", "😀", "<|endof"]
    for _ in range(20):
        texts = ["".join(pick.choices(odd if pick.random() < 0.2 else plain, k=pick.choice([0, 1, 2, 3, 12, 40]))) for _ in range(100)]
        assert e.encode(pa.array(["left out", *texts])[1:]) == e._odd_ids(texts) == e.pieces._library(texts)
        assert len(e.known) == len(e.ids) <= 200
    assert e.encode(pa.array([], pa.string())) == [] and e.encode(pa.array(["a b"], pa.large_string())) == e.pieces._library(["a b"])
    with pytest.raises(Exception):
        e.encode(pa.array([b"\xc3", b"\xa9"], pa.binary()).view(pa.string()))


def test_batches_are_cut_and_joined_by_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "CHUNK_BYTES", 10)
    texts = [None, "abcd", "efgh", "ijkl", "", "x" * 30, "y", None, "z" * 9, "", "tail"]
    for size in (1, 3, 11):
        batches = pa.table({"doc_id": range(11), "text": texts}).to_batches(max_chunksize=size)
        parts = [p.column(1).to_pylist() for p in token_files.chunks(batches)]
        assert sum(parts, []) == texts
        assert all(sum(len(t or "") for t in p) <= 10 or [t for t in p if t] == ["x" * 30] for p in parts) and len(parts) == 5
    assert list(token_files.chunks([])) == []


def test_very_long_texts_and_repeated_rows(spark, table):
    long = "Some words, and 12 numbers; x" + "y" * 5000 + " é ü\n" * 20_000 + "tail  of   it " * 20_000
    df = table([(1, long), (1, long), (2, "a b"), (None, "a b")])
    tok, word, sp = vocab.hf("byte_bpe_50k.json"), vocab.hf("word_bpe_49k.json"), vocab.sp("piece_bpe_32k.model")
    _, back = read_back(spark, id_and_text(df))
    want = tok.encode(long, add_special_tokens=False).ids + [2]
    rows = [r for r in back.collect() if r.doc_id == 1]
    assert [(r.n_tokens, r.ids_crc32) for r in rows] == [(len(want), brute.crc(want))] * 2
    assert sorted(r.n_tokens for r in token_counts.count_tokens(id_and_text(df)).collect()) == sorted([len(sp.encode(long))] * 2 + [len(sp.encode("a b"))] * 2)
    n = len(word.encode(long, add_special_tokens=False).ids)
    assert sorted(r.n_tokens for r in pair_bpe.encode(id_and_text(df)).collect()) == [2, 2, n, n]


def test_vocabularies_that_texts_cannot_be_cut_for():
    with pytest.raises(ValueError):
        token_files.PieceEncoder("word_bpe_49k.json")
    with pytest.raises(ValueError):
        pair_bpe.PairCoder("byte_bpe_50k.json")


def test_ranks_that_do_not_ascend_are_merged_by_the_library(monkeypatch):
    coder = pair_bpe.PairCoder("word_bpe_49k.json")
    coder.index.ascending = False
    text = "internationalization of strange wörds, 123 & more"
    ids = " ".join(x[1] for x in coder.encode([text])[0])
    assert ids == " ".join(map(str, coder.tok.encode(text, add_special_tokens=False).ids))
    assert coder.decode(ids) == coder.tok.decode(list(map(int, ids.split())), skip_special_tokens=False)


def test_strings_in_use_stay_when_the_memo_is_full(monkeypatch):
    monkeypatch.setattr(pair_bpe, "MEMO", 100)
    c, learned = pair_bpe.PairCoder("word_bpe_49k.json"), []
    learn = c._learn
    monkeypatch.setattr(c, "_learn", lambda pieces: (learned.append(pieces), learn(pieces)))
    common = [f"Common{j}," for j in range(20)]
    for k in range(12):
        text = " ".join(common + [f"once{k}x{j}" for j in range(20)])
        assert " ".join(x[1] for x in c.encode([text])[0]) == " ".join(map(str, c.tok.encode(text, add_special_tokens=False).ids))
    assert learned[0][:20] == common and not any(set(common) & set(pieces) for pieces in learned[1:])


def test_rounds_merge_as_lists_of_places_do():
    import random

    index, pick = pair_bpe.PairCoder("word_bpe_49k.json").index, random.Random(7)
    letters = [chr(c) for c in token_files.byte_letters().values()]
    words = ["".join(pick.choices(pick.choice([letters, "etaoinshr", "ab", "a"]), k=pick.randint(1, 2 * pair_bpe.SHORT))) for _ in range(2000)]
    assert index.merge(words) == index.merge_long(words) and index.merge([]) == []
    assert index.rounds(words) == index.merge_long(words)
