import re

import brute
import corpus_pipeline as cp
from veracell.llm import pii, queries, vocab

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    rows = [(1, "The first clean text has more than ten words in it for sure, and ann@example.com too."), (2, "The first clean text has more than ten words in it for sure, and ann@example.com too."),
            (3, None), (4, "few words"), (5, "Another text which is clean and stays whole through all of the stages without a change at all.")]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "this benchmark passage of eight words is nowhere here")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), ["doc_id", "text", "lang", "source", "n_chars"]
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert k == len(cp.STAGES) - 1 or docs.columns == columns
    assert sorted(r.doc_id for r in docs.collect()) == [1, 5]
    clean = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "personal_data")).collect()}
    assert clean[5] == rows[4][1] and "<EMAIL>" in clean[1]
    assert sorted(r.doc_id for r in cp.run(spark, str(tmp_path)).collect()) == [1, 5]


def test_eleven_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 11))


def without_passages(text, bench):
    """The text without its runs of hit words, found window by window."""
    words = list(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text))
    low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in m[0]) for m in words]
    hit = set()
    for item in bench:
        own = brute.words6(item)
        for k in range(max(1, len(own) - 7) if own else 0):
            w = own[k : k + 8]
            for at in range(len(low) - len(w) + 1):
                if low[at] == w[0] and low[at : at + len(w)] == w:
                    hit |= set(range(at, at + len(w)))
    out, last = [], 0
    for k in sorted(hit):
        if k - 1 not in hit:
            out.append(text[last : words[k].start()])
        last = words[k].end()
    return "".join(out) + text[last:]


def test_whole_pipeline_against_plain_definitions(spark):
    """All documents of a small table through the five stages, one by one in Python."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {}
    for d, t in docs.items():
        n, chars, symbols, dup, _, failed = brute.quality(t)
        lines = sum(bool(re.search("[^\x20\x09-\x0d]", x)) for x in (t or "").split("\n"))
        if not (failed or (10 * symbols > n > 0) or chars < 2 * n or chars > 25 * n or (2 * dup > lines and dup > 2)):
            kept[d] = t
    groups = brute.components({d: brute.simhash(t) for d, t in kept.items()})
    tok, field, want = vocab.hf("word_bpe_49k.json"), pii.field(), {}
    for d, t in kept.items():
        if groups[d] == d:
            t = without_passages(t, bench)
            want[d] = tok.encode(pii.redacted(t, pii.scan(field, t)[1]), add_special_tokens=False).ids
    got = {r.doc_id: list(r.ids) for r in cp.run(spark, SF).collect()}
    assert len(want) > 50 and len(want) < len(kept) < len(docs) and got == want
