"""Operator 7: token counts by the whole-token shortcut.

Before any text is read, each vocabulary string is proved, by encoding it
alone, to be one token. Texts are cut into pre-tokens where no merge can cross
(before a run of spaces: no vocabulary string has a space after another
character, which is checked). A pre-token that is a proved string counts one;
only the rest are merged, once each, and kept in a bounded memo.

Defined results: a null or empty text has no bytes and no tokens; special
strings inside a text are ordinary text, as the library takes them; repeated
rows are counted each; an empty table gives no rows; other columns are unread.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from . import vocab
from .common import arrow_map, id_and_text

SPACE = "▁"
LIMIT = 4096
#: Most strings that a worker remembers, and most characters of one.
MEMO, LONG = 1_200_000, 100
RUNS = re.compile(" +[^ ]*")


class WholeTokenCounter:
    """Counts of a sentencepiece BPE model that keeps white space as it is."""

    def __init__(self, name: str):
        self.sp = sp = vocab.sp(name)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [p for i, p in enumerate(pieces) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        # cutting is exact only if spaces stand nowhere but in front, and stay as they are
        exact = not any(SPACE in p.lstrip(SPACE) for p in plain) and len(sp.encode("a  b ", out_type=str)) == len(
            sp.encode("a")) + len(sp.encode(" b")) + 1
        if not exact:
            raise ValueError(f"{name}: a text of this model can't be cut before spaces")
        alone = [p[1:] for p in plain if p[0] == SPACE and len(p) > 1 and p[1] != SPACE]
        self.whole = {w: 1 for w, ids in zip(alone, sp.encode(alone)) if len(ids) == 1}
        self.memo = dict(self.whole)

    def count(self, texts: list[str]) -> list[int]:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
            memo.update(self.whole)
        cut, missing = [], {}
        for text in texts:
            if SPACE in text:
                text = text.replace(SPACE, " ")
            # one space is put in front of every text that isn't empty
            pieces = text.split(" ") if text else []
            if "" in pieces:
                pieces = [p[1:] for p in RUNS.findall(" " + text)]
            for p in pieces:
                if p not in memo:
                    missing[p] = None
            cut.append(pieces)
        rest = list(missing)
        memo.update(zip(rest, map(len, self.sp.encode(rest, num_threads=1))))
        for p in rest:
            if not p:  # a lone space in front, of nothing: the library takes an empty text as none
                memo[p] = 1
        out = [sum(map(memo.__getitem__, pieces)) for pieces in cut]
        for p in rest:
            if len(p) > LONG:
                del memo[p]
        return out


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of (doc_id, text); no shuffle."""

    def build():
        counter = vocab.once(("whole", model), lambda: WholeTokenCounter(model))

        def work(ids, texts):
            texts = [t or "" for t in texts]
            n = counter.count(texts)
            return {"doc_id": ids, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return work

    return arrow_map(docs, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", build)


def op7_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(id_and_text(spark.read.parquet(f"{sf_dir}/documents.parquet")))
