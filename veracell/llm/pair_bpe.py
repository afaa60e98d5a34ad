"""Operator 8: BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens that a partition hasn't merged before are laid end to
end as one symbol list, and an index holds the rank of the adjacent pair at each
position. Pre-tokens of up to ``SHORT`` symbols go through rounds over whole
arrays: a round merges, in all pre-tokens at once, every position of each one's
lowest rank, and the ranks of the pairs that appear to the left and right are
looked up again. In longer ones an index maps each pair to all its positions, and
ranks that occur are applied in ascending order: one rank merges at all its
positions, and new pairs join the lists of their ranks; so no round passes over a
long string. Both equal merging each pre-token by its lowest rank first as long
as a merge never makes a pair of lower rank, which is checked for the vocabulary
once (the library merges the words of one that fails). Results are kept in a
bounded memo of two halves: when the younger is full, the older goes, so strings
in use stay. Texts are decoded from the ids, string by string.

The vocabulary's normalizer and splitter are the library's. Neither looks
across white space, so texts are cut there: strings of plain Latin letters need
neither, all other strings are handed to the library's own normalizer and
splitter once each.

Defined results: a null or empty text has no ids, the hash of the empty string
and an empty decoding; strings of added tokens inside a text become those
tokens, as in the library; repeated rows are coded each; an empty table gives no
rows; other columns are unread.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import vocab
from .common import SLICE_ROWS, id_and_text

MEMO = 500_000
#: Symbols of the pre-tokens that are merged in rounds.
SHORT = 64
_NONE = np.int64(1) << 40
#: Lower case letters that are normalized already, then signs that no rule of
#: the splitter cuts: one pre-token of each.
PLAIN = re.compile("([a-zß-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
#: White space as the vocabulary's splitter sees it; str.split also cuts at these four.
SEPARATORS = re.compile("[\x1c-\x1f]")
STRINGS = re.compile("[^ \t\n\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def strings(text: str) -> list[str]:
    return STRINGS.findall(text) if SEPARATORS.search(text) else text.split()


class PairIndex:
    """Merges many symbol sequences together."""

    def __init__(self, tokenizer):
        model = json.loads(tokenizer.to_str())["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        ids, prefix = model["vocab"], len(model.get("continuing_subword_prefix") or "")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ids = ids
        #: (left id << 32 | right id) to (rank, id of both)
        self.ranks = {ids[a] << 32 | ids[b]: (k, ids[a + b[prefix:]]) for k, (a, b) in enumerate(merges)}
        made: dict[int, int] = {}
        for rank, new in self.ranks.values():
            made[new] = max(made.get(new, -1), rank)
        self._arrays()
        self.ascending = prefix == 0 and not model.get("ignore_merges") and all(
            rank > max(made.get(pair >> 32, -1), made.get(pair & 0xFFFFFFFF, -1)) for pair, (rank, _) in self.ranks.items())

    def _arrays(self) -> None:
        """The vocabulary as arrays, for the rounds: ids of single letters, inside
        and at the end of a word, and the pairs sorted."""
        single = [(ord(c[0]), c, i) for c, i in self.ids.items() if c and c[1:] in ("", self.suffix) and c[0] <= "\uffff"]
        self.inner = np.full(1 << 16, -1, np.int64)
        self.final = self.inner.copy()
        for k, c, i in single:
            if len(c) == 1:
                self.inner[k] = i
            if c == chr(k) + self.suffix:
                self.final[k] = i
        self.pairs = np.array(sorted(self.ranks) or [-1], np.int64)
        self.pair_rank = np.array([self.ranks[p][0] for p in self.pairs.tolist()] if self.ranks else [_NONE], np.int64)
        self.made = np.zeros(max([0, *[rank for rank, _ in self.ranks.values()]]) + 1, np.int64)
        for rank, new in self.ranks.values():
            self.made[rank] = new

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], _NONE)

    def rounds(self, words: list[str]) -> list[list[int]]:
        """Ids of each pre-token, in the byte-level alphabet; none is empty."""
        size = np.array(list(map(len, words)), np.int64)
        letters = np.frombuffer("".join(words).encode("utf-16-le"), np.uint16)
        last = np.cumsum(size) - 1
        sym, own = self.inner[letters], np.repeat(np.arange(len(words)), size)
        sym[last] = self.final[letters[last]]
        if (sym < 0).any():
            raise KeyError("a letter that the vocabulary does not have")
        rank = np.full(len(sym), _NONE)
        inside = np.flatnonzero(own[1:] == own[:-1])
        rank[inside] = self._rank(sym[inside], sym[inside + 1])
        done = []  # (word, symbols) of the words without a pair left
        while len(sym):
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            count = np.diff(np.append(first, len(own)))
            low = np.repeat(np.minimum.reduceat(rank, first), count)
            over = low == _NONE
            if over.any():
                done.append((own[over], sym[over]))
                sym, own, rank, low = (x[~over] for x in (sym, own, rank, low))
                if not len(sym):
                    break
            at = np.flatnonzero(rank == low)
            # places that overlap (one letter again and again): every other one, from the left
            fresh = np.append(True, np.diff(at) > 1)
            if not fresh.all():
                run = at[fresh][np.cumsum(fresh) - 1]
                at = at[(at - run) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, own, rank = sym[keep], own[keep], rank[keep]
            at -= np.arange(len(at))
            near = np.concatenate((at, at[at > 0] - 1))
            rank[near] = _NONE
            near = near[near + 1 < len(sym)]
            near = near[own[near] == own[near + 1]]
            rank[near] = self._rank(sym[near], sym[near + 1])
        own, sym = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(own, kind="stable")
        sym, end = sym[order].tolist(), np.cumsum(np.bincount(own, minlength=len(words))).tolist()
        return [sym[a:b] for a, b in zip([0, *end], end)]

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each pre-token, given in the byte-level alphabet."""
        short = [w for w in words if len(w) <= SHORT]
        if len(short) == len(words):
            return self.rounds(words) if words else []
        near, far = iter(self.rounds(short) if short else ()), iter(self.merge_long([w for w in words if len(w) > SHORT]))
        return [next(near if len(w) <= SHORT else far) for w in words]

    def merge_long(self, words: list[str]) -> list[list[int]]:
        """Ids of each pre-token, given in the byte-level alphabet."""
        ids, ranks, suffix = self.ids, self.ranks, self.suffix
        sym: list[int] = []  # -1 stands between words
        for w in words:
            sym.extend([ids[c] for c in w[:-1]])
            sym.append(ids[w[-1] + suffix])
            sym.append(-1)
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        left = -1
        for at, right in enumerate(sym):
            if left >= 0 and right >= 0 and (pair := left << 32 | right) in ranks:
                index.setdefault(pair, []).append(at - 1)
            left = right
        active = [(ranks[p][0], p) for p in index]
        heapify(active)
        while active:
            _, pair = heappop(active)
            a, b, new = pair >> 32, pair & 0xFFFFFFFF, ranks[pair][1]
            places = index.pop(pair)
            places.sort()
            for at in places:
                if sym[at] != a or sym[nxt := after[at]] != b:
                    continue  # another merge took one of the two
                sym[at], sym[nxt] = new, -2
                after[at] = far = after[nxt]
                if (right := sym[far]) >= 0:
                    before[far] = at
                    if (p := new << 32 | right) in ranks:
                        if p in index:
                            index[p].append(at)
                        else:
                            index[p] = [at]
                            heappush(active, (ranks[p][0], p))
                elif far < n:
                    before[far] = at
                if (back := before[at]) >= 0 and (left := sym[back]) >= 0 and (p := left << 32 | new) in ranks:
                    if p in index:
                        index[p].append(back)
                    else:
                        index[p] = [back]
                        heappush(active, (ranks[p][0], p))
        out, word = [], []
        for s in sym:
            if s >= 0:
                word.append(s)
            elif s == -1:
                out.append(word)
                word = []
        return out


class PairCoder:
    """Encodes and decodes whole texts; memo of (n, decimal ids, tokens) by string."""

    def __init__(self, name: str):
        from .token_files import byte_letters

        self.tok = tok = vocab.hf(name)
        self.index = PairIndex(tok)
        rules = json.loads(tok.to_str())
        kinds = lambda x, many: [k["type"] for k in (x or {}).get(many, [x] if x else [])]
        known = kinds(rules["normalizer"], "normalizers"), kinds(rules["pre_tokenizer"], "pretokenizers")
        if known != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or rules["decoder"] or rules["model"].get("continuing_subword_prefix"):
            raise ValueError(f"{name}: texts are cut at white space for another normalizer, splitter and decoder than this vocabulary's")
        self.letters = byte_letters()
        self.bytes = {chr(c): b for b, c in self.letters.items()}
        self.names = {str(i): t for t, i in tok.get_vocab(with_added_tokens=True).items()}
        self.number = list(map(str, range(max(self.index.ids.values()) + 1)))
        self.token = [self.names.get(i, "") for i in self.number]
        self.added = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.memo: dict[str, tuple[int, str, str]] = {}
        self.words: dict[str, tuple[int, str, str]] = {}
        self.older: tuple[dict, dict] = {}, {}

    def _learn(self, pieces: list[str]) -> None:
        """Splits new strings into pre-tokens and merges those that are new together."""
        letters, memo, words, old, split, new = self.letters, self.memo, self.words, self.older[1], [], {}
        for p in pieces:
            if m := PLAIN.fullmatch(p.lower()):
                parts = m.groups() if m[2] else (m[1],)
            else:
                parts = [bytes(self.bytes[c] for c in w).decode() if w else w for w, _ in
                         self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(p))]
            split.append(parts)
            for w in parts:
                if w and w not in words:
                    if w in old:
                        words[w] = old[w]
                    else:
                        new[w] = None
        mapped = [w.encode().decode("latin-1").translate(letters) for w in new]
        # ranks that don't ascend can't be applied in order: the library's model merges such a vocabulary's words
        merged = self.index.merge(mapped) if self.index.ascending else [[t.id for t in self.tok.model.tokenize(w)] for w in mapped]
        number, token = self.number.__getitem__, self.token.__getitem__
        for w, ids in zip(new, merged):
            words[w] = (len(ids), " ".join(map(number, ids)), " ".join(map(token, ids)))
        for p, parts in zip(pieces, split):
            if len(parts) == 1:
                memo[p] = words[parts[0]]
            else:
                got = [words[w] for w in parts if w]
                memo[p] = (sum([x[0] for x in got]), " ".join([x[1] for x in got]), " ".join([x[2] for x in got]))

    def encode(self, texts: list[str]) -> list[list[tuple[int, str, str]]]:
        """For each text its strings' (n, decimal ids, tokens), in order."""
        known, old, found, missing = self.memo.get, self.older[0], [], {}
        for text in texts:
            if self.special and self.special.search(text):
                pieces = []
                for k, part in enumerate(self.special.split(text)):
                    pieces += [part] if k % 2 else strings(part)
            else:
                pieces = strings(text)
            got = list(map(known, pieces))
            gaps = [(k, p) for k, p in enumerate(pieces) if got[k] is None] if None in got else ()
            for _, p in gaps:
                missing[p] = None
            found.append((got, gaps))
        if missing:
            if len(self.memo) + len(missing) > MEMO // 2:
                self.older = self.memo, self.words
                self.memo, self.words = {}, {}
            memo, new = self.memo, []
            for p in missing:
                if p in old:
                    memo[p] = old[p]
                elif p in self.added:
                    memo[p] = (1, str(self.added[p]), self.decode(str(self.added[p])))
                else:
                    new.append(p)
            self._learn(new)
            for got, gaps in found:
                for k, p in gaps:
                    got[k] = memo[p]
        return [got for got, _ in found]

    def decode(self, coded: str) -> str:
        """The tokens of decimal ids, joined as the library joins those of a
        vocabulary without a decoder; unknown ids are left out."""
        return " ".join(filter(None, map(self.names.get, coded.split())))


def id_lists(coded: list[str], counts: list[int]) -> pa.Array:
    """Lists of the decimal ids in each string; an empty string has none."""
    flat = pc.split_pattern(pa.array([" ".join(filter(None, coded))], pa.large_string()), " ").flatten()
    flat = flat.cast(pa.int32()) if any(counts) else pa.array([], pa.int32())
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), flat)


def encode(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of (doc_id, text), and with
    ``ids`` the ids themselves; no shuffle."""
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches):
        coder = vocab.once(("pairs", tokenizer), lambda: PairCoder(tokenizer))
        sha = hashlib.sha256
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                gc.disable()  # nothing here is cyclic, and a collection would walk the whole memo
                try:
                    out = coder.encode([t or "" for t in part.column(1).to_pylist()])
                finally:
                    gc.enable()
                coded = [" ".join([x[1] for x in d]) for d in out]
                counts = [c.count(" ") + 1 if c else 0 for c in coded]
                cols = [part.column(0), pa.array(counts, pa.int64()),
                        pa.array([sha(c.encode()).hexdigest() for c in coded], pa.string()),
                        pa.array([sha(" ".join([x[2] for x in d]).encode()).hexdigest() for d in out], pa.string())]
                if ids:
                    cols.append(id_lists(coded, counts))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cols)])

    return docs.mapInArrow(run, schema)


def decode(coded: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id and text of (doc_id, ids): the tokens, joined as the library
    joins those of a vocabulary without a decoder; nulls are empty."""

    def run(batches):
        coder = vocab.once(("pairs", tokenizer), lambda: PairCoder(tokenizer))
        for batch in batches:
            texts = [coder.decode(" ".join(map(str, x or ()))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def op8_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(id_and_text(spark.read.parquet(f"{sf_dir}/documents.parquet")))
