"""Operator 1: token ids in seekable files of independent zstandard frames.

A shard is a valid zstandard stream that any decoder reads whole:

* data frames, each compressed alone with its own checksum, holding the ids
  (unsigned 32-bit little-endian) of whole documents until ``FRAME_BYTES`` are
  reached; one long document may make a larger frame;
* one skippable frame with the document table: (doc_id, validity, frame, first
  id in the frame, number of ids) for each document, zlib-checked;
* the public "seekable format" trailer: a skippable frame with compressed size,
  decompressed size and xxh64 checksum of each data frame.

A reader fetches the trailer, then only the frames of the documents asked for.

Shards are cut by ranges of doc_id, so shard order is document order; rows of one
id, or of none, are told apart by a number, so that they too can be cut. There is a shard for
each ``SHARD_BYTES`` of text, and at least one for each core. A task
attempt writes a file of its own and names it in the manifest that Spark keeps
from the attempt that succeeded; a lost executor costs a rerun of its tasks and
an orphaned file, never a wrong one.

Defined results: a null or empty text is the end id alone; a null doc_id sorts
first and comes back null; repeated doc_ids each keep their own entry, in no
set order among themselves; an empty table gives no shards and no rows; columns
other than id and text are not read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vocab
from .common import Scratch, id_and_text, opened

FRAME_BYTES, SHARD_BYTES = 1 << 18, 128 << 20
SEEK_MAGIC, SEEK_FOOTER, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
ENTRY = struct.Struct("<qBIII")
#: Entries of each of the two generations of a worker's memos, of pieces and of pre-tokens.
MEMO, WORDS = 300_000, 800_000
#: Bytes of text that are cut together, entries of the memo of their pre-tokens and its bytes.
CHUNK_BYTES, KNOWN, KNOWN_BYTES = 8 << 20, 2_000_000, 64 << 20


class ShardWriter:
    """Writes one shard; documents come in file order."""

    def __init__(self, uri: str, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.out, self.frame_bytes = opened(uri, "w"), frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.held: list[bytes] = []
        self.held_bytes = self.n_docs = self.n_ids = 0
        self.frames: list[bytes] = []
        self.docs: list[bytes] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(ENTRY.pack(doc_id or 0, doc_id is not None, len(self.frames), self.held_bytes // 4, len(ids) // 4))
        self.held.append(ids)
        self.held_bytes += len(ids)
        self.n_docs += 1
        self.n_ids += len(ids) // 4
        if self.held_bytes >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        import xxhash

        if not self.held:
            return
        raw = b"".join(self.held)
        packed = self.zstd.compress(raw)
        self.out.write(packed)
        self.frames.append(struct.pack("<III", len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.held_bytes = [], 0

    def close(self) -> None:
        self._flush()
        table = zlib.compress(b"".join(self.docs), 6)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(table)) + table)
        body = b"".join(self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_FOOTER)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(body)) + body)
        self.out.close()


class ShardReader:
    """Reads a shard's tables at once and frames on demand."""

    def __init__(self, uri: str):
        import zstandard

        self.file = opened(uri, "r")
        self.zstd = zstandard.ZstdDecompressor()
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_FOOTER:
            raise ValueError(f"{uri}: no seek table")
        seek = self._at(size - 9 - 12 * n, 12 * n)
        self.frames = list(struct.iter_unpack("<III", seek))
        self.offsets = [0, *accumulate(f[0] for f in self.frames)]
        magic, length = struct.unpack("<II", self._at(self.offsets[-1], 8))
        if magic != INDEX_MAGIC:
            raise ValueError(f"{uri}: no document table")
        self.docs = list(ENTRY.iter_unpack(zlib.decompress(self._at(self.offsets[-1] + 8, length))))

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        import xxhash

        packed, raw, check = self.frames[k]
        data = self.zstd.decompress(self._at(self.offsets[k], packed), max_output_size=raw)
        if len(data) != raw or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k}: checksum mismatch")
        return data

    def document(self, k: int) -> tuple[int | None, bytes]:
        """The k-th document; reads the one frame it lies in."""
        doc_id, known, frame, first, n = self.docs[k]
        return doc_id if known else None, self.frame(frame)[4 * first : 4 * (first + n)]

    def __iter__(self):
        at, data = -1, b""
        for doc_id, known, frame, first, n in self.docs:
            if frame != at:
                at, data = frame, self.frame(frame)
            yield doc_id if known else None, data[4 * first : 4 * (first + n)]


LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Pieces of these characters are split here; the library splits all others.
PLAIN = re.compile(rf"[{LATIN}0-9\n!-/:-@\[-`{{-~]*")
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+")


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: visible bytes are themselves, others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(rest)}


class PieceEncoder:
    """The library's ids of whole texts, through memos.

    A space before a character that is not white space always begins a
    pre-token, and nothing to its left changes with what follows it, so a text
    may be cut there and the pieces encoded alone. Pieces of plain Latin
    characters are cut into pre-tokens, whose merges the library's model makes
    once each; other pieces go through the whole library, and so does a whole
    text with white space after a space or with the string of an added token.
    """

    def __init__(self, name: str):
        self.tok = vocab.hf(name)
        split = json.loads(self.tok.to_str())
        plan = split["pre_tokenizer"] or {}
        if split["normalizer"] or plan.get("type") != "ByteLevel" or not plan.get("use_regex") or plan.get("add_prefix_space"):
            raise ValueError(f"{name}: texts are cut for a byte-level splitter without a normalizer only")
        self.model = self.tok.model
        self.letters = byte_letters()
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        if (ids := self.words.get(word)) is None:
            if (ids := self.old_words.get(word)) is None:
                mapped = word.encode().decode("latin-1").translate(self.letters)
                ids = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
            self.words[word] = ids
        return ids

    def _learn(self, pieces: list[str]) -> None:
        memo, word, odd = self.memo, self._word, []
        if len(self.words) > WORDS:
            self.old_words, self.words = self.words, {}
        for p in pieces:
            if p.isascii() and p.isalpha():
                memo[p] = word(" " + p)
            elif p[-1] in ".,;" and (stem := p[:-1]).isascii() and stem.isalpha():
                memo[p] = word(" " + stem) + word(p[-1])
            elif PLAIN.fullmatch(p):
                memo[p] = b"".join(map(word, SPLIT.findall(" " + p)))
            else:
                odd.append(p)
        memo.update(zip(odd, self._library([" " + p for p in odd])))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) > MEMO:  # what was used since the last time stays at hand
            self.old, self.memo = self.memo, {}
        memo, old, cut, whole, missing = self.memo, self.old, [], [], []
        for text in texts:
            first, *rest = text.split(" ")
            new = {p for p in rest if p not in memo}
            if any(a in text for a in self.added) or any(not p or p[0].isspace() for p in new):
                rest = None
            else:
                for p in new:
                    if p in old:
                        memo[p] = old[p]
                    else:
                        memo[p] = b""
                        missing.append(p)
            cut.append((first, rest))
        if missing:
            self._learn(missing)
        out: list[bytes] = []
        # a text's first piece stands as it is; the others follow a space
        for k, ((_, rest), ids) in enumerate(zip(cut, self._library([first for first, _ in cut]))):
            if rest is None:
                whole.append(k)
                out.append(b"")
            else:
                out.append(ids + b"".join(map(memo.__getitem__, rest)))
        for k, ids in zip(whole, self._library([texts[k] for k in whole])):
            out[k] = ids
        return out


def byte_kinds() -> np.ndarray:
    """Kinds of the bytes of plain texts: 1 letters, 2 digits, 3 signs, 4 white
    space; 0 is in no plain text. Letters beyond ASCII have two bytes."""
    kinds = np.zeros(256, np.uint8)
    kinds[33:127] = 3
    kinds[[10, 32]] = 4
    kinds[48:58] = 2
    kinds[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = 1
    return kinds


def span(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets, from 0, and bytes of an array of strings without nulls."""
    if not len(texts):
        return np.zeros(1, np.int32), np.zeros(0, np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


class WordEncoder:
    """The library's ids of many texts at once.

    Plain texts (no characters but those of ``PLAIN`` and spaces, no string of an
    added token) are cut into pre-tokens by passes over the bytes of them all;
    Arrow tells the distinct ones apart, the library's model merges each once, and
    the ids are gathered. Pre-tokens stay in a bounded memo; when it is full, those
    of the last chunk remain. All other texts go through ``PieceEncoder``.
    """

    def __init__(self, name: str):
        self.pieces = PieceEncoder(name)
        self.kinds = byte_kinds()
        letters = self.pieces.letters
        self.letters = np.array([letters[b] for b in range(256)], "<u2")
        self.known, self.ids = pa.array([], pa.binary()), pa.array([], pa.binary())

    def _plain(self, texts: pa.Array) -> np.ndarray:
        offsets, data = span(texts)
        odd = [np.flatnonzero(self.kinds[data] == 0)]
        # the two signs among the letters, and what follows them
        for lead, bad in ((0xC3, (0x97, 0xB7)), (0xC9, range(0x90, 0xC0))):
            at = np.flatnonzero(data == lead)
            odd.append(at[np.isin(data[at + 1], bad)])
        plain = np.diff(offsets) <= CHUNK_BYTES
        plain[np.searchsorted(offsets, np.concatenate(odd), side="right") - 1] = False
        for added in self.pieces.added:
            plain &= ~pc.match_substring(texts, added).to_numpy(zero_copy_only=False)
        return plain

    def _starts(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Where the pre-tokens of plain texts begin: what ``SPLIT`` finds."""
        n, kind = len(data), self.kinds[data]
        begin, end = offsets[:-1], offsets[1:]
        begin, end = begin[begin < end], end[begin < end]
        white, space = kind == 4, data == 32
        start = np.ones(n, bool)
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start[1:] &= white[1:] | ~space[:-1]  # a space belongs to what follows it
        last = np.zeros(n, bool)  # so the last of several spaces stands apart
        last[1:-1] = white[1:-1] & white[:-2] & ~white[2:]
        last[end - 1] = False
        start |= last
        start[begin] = True
        at = np.flatnonzero(data == 39)  # 's and the like, where a pre-token begins with the sign
        if len(at):
            text = np.searchsorted(begin, at, side="right") - 1
            left, room = at - 1, end[text] - at
            at, room = (x[(at == begin[text]) | ((kind[left] != 3) & ~space[left])] for x in (at, room))
            one, two, three = (np.where(room > k, data[np.minimum(at + k, n - 1)], 0) for k in (1, 2, 3))
            short = np.isin(one, list(b"stmd"))
            long = ((one == 108) & (two == 108)) | (((one == 114) | (one == 118)) & (two == 101))
            start[at[short | long] + 1] = False
            for hit, size, after in ((short, 2, two), (long, 3, three)):
                start[at[hit & (self.kinds[after] == 1)] + size] = True
        return np.flatnonzero(start).astype(np.int32)

    def _merge(self, words: pa.Array) -> pa.Array:
        offsets, data = span(words)
        text, tokenize = self.letters[data].tobytes().decode("utf-16-le"), self.pieces.model.tokenize
        ids, ends, at = array("I"), [0], offsets.tolist()
        for a, b in zip(at, at[1:]):
            ids.extend([t.id for t in tokenize(text[a:b])])
            ends.append(4 * len(ids))
        return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(array("i", ends)), pa.py_buffer(ids)])

    def _plain_ids(self, texts: pa.Array) -> list[bytes]:
        offsets, data = span(texts)
        starts = self._starts(offsets, data)
        bounds = np.append(starts, np.int32(len(data)))
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        found = pc.index_in(words.dictionary, value_set=self.known)
        new = words.dictionary.filter(pc.is_null(found))
        place = found.fill_null(-1).to_numpy().copy()
        place[place < 0] = len(self.known) + np.arange(len(new))
        known, ids = pa.concat_arrays([self.known, new]), pa.concat_arrays([self.ids, self._merge(new)])
        at, raw = span(ids.take(pa.array(place[words.indices.to_numpy()])))
        at, raw = at[np.searchsorted(starts, offsets)].tolist(), raw.tobytes()
        if len(known) > KNOWN or known.nbytes + ids.nbytes > KNOWN_BYTES:
            known, ids = words.dictionary, ids.take(pa.array(place))
            if len(known) > KNOWN:
                known, ids = known[:0], ids[:0]
        self.known, self.ids = known, ids
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text, little-endian; a null is an empty text."""
        texts = texts.cast(pa.string()).fill_null("")
        texts.validate(full=True)  # what is not UTF-8 is refused
        plain = self._plain(texts)
        if plain.all():
            return self._plain_ids(texts)
        easy = iter(self._plain_ids(texts.filter(pa.array(plain))))
        hard = iter(self._odd_ids(texts.filter(pa.array(~plain)).to_pylist()))
        return [next(easy if p else hard) for p in plain.tolist()]

    def _odd_ids(self, texts: list[str]) -> list[bytes]:
        return [ids for at in range(0, len(texts), 512) for ids in self.pieces.encode(texts[at : at + 512])]


def chunks(batches):
    """Batches cut and joined to about ``CHUNK_BYTES`` of text, the second column."""
    held, size = [], 0
    for batch in batches:
        sizes = pc.binary_length(batch.column(1)).fill_null(0).to_numpy()
        at = 0
        for k, n in enumerate(sizes.tolist()):
            if size and size + n > CHUNK_BYTES:
                held.append(batch.slice(at, k - at))
                yield pa.Table.from_batches(held)
                held, size, at = [], 0, k
            size += n
        held.append(batch.slice(at))
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def write_shards(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", end_id: int | None = 2,
                 frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Encodes (doc_id, text) into shards; returns the manifest, one row a shard.

    A count of bytes, then one range shuffle of the texts; Spark's sampling finds the ranges.
    """
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches):
        coder = vocab.once(("words", tokenizer), lambda: WordEncoder(tokenizer))
        writer = first = part_id = None
        for part in chunks(batches):
            ids = part.column(0).to_pylist()
            if writer is None:
                first, part_id, uri = ids[0], part.column(2)[0].as_py(), f"{folder}/{uuid.uuid4().hex}.tok"
                writer = ShardWriter(uri, frame_bytes)
            for doc_id, coded in zip(ids, coder.encode(pa.concat_arrays(part.column(1).chunks))):
                writer.add(doc_id, coded + end)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"path": [uri], "first_doc": pa.array([first], pa.int64()), "n_docs": [writer.n_docs], "n_ids": [writer.n_ids], "part": pa.array([part_id], pa.int32())})

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(-(-size // SHARD_BYTES), docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered = ordered.select("doc_id", "text", F.spark_partition_id().alias("part"))
    return ordered.mapInArrow(run, "path string, first_doc bigint, n_docs bigint, n_ids bigint, part int")


def shard_starts(manifest: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all shards before. One row a shard, so the
    window's single partition holds file names only."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_shards(manifest: DataFrame, doc_ids: frozenset[int] | None = None) -> DataFrame:
    """Documents of the shards: doc_id, start, n_tokens, ids_crc32 and the ids;
    with ``doc_ids`` only the frames that hold those are read."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, frame int"

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                with ShardReader(path) as reader:
                    if doc_ids is None:
                        for (doc_id, ids), entry in zip(reader, reader.docs):
                            rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), entry[2]))
                            start += len(ids) // 4
                    else:
                        for k, (doc_id, _, frame, _, n) in enumerate(reader.docs):
                            if doc_id in doc_ids:
                                ids = reader.document(k)[1]
                                rows.append((doc_id, start, n, zlib.crc32(ids), frame))
                            start += n
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "frame"])

    return manifest.select("path", "start").mapInArrow(run, schema)


def op1_seekable_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards of the whole ``documents`` table, reads them back."""
    docs = id_and_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    scratch = Scratch(spark, "token-files")
    manifest = scratch.keep(write_shards(docs, f"{scratch.folder}/shards"), "manifest")
    # a task a shard: adaptive execution would put rows this small all in one
    return read_shards(shard_starts(manifest).repartition(max(1, manifest.count())))
