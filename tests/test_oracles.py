"""Some catalogue queries against their SQL; the driver compares all of them."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [
    "value_registry", "grammar_distribution", "char_trigram_support", "numeric_profile", "prototype_nearest", "context_disagreement", "dependency_candidates", "evidence_features",
    "gate_weak_prior", "four_zone", "repair_candidates", "cosine_topk", "cell_scores", "rule_provenance", "relation_observations", "table_fingerprint", "corrupted_values", "made_errors",
    "identifier_and_rule_consensus", "trace_file", "csv_cells", "disjoint_rules", "key_alignment", "text_shape_profile", "aligned_annotations",
]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def rows(frame, columns):
    tell = lambda v: "null" if v is None or v != v else f"{float(v):.5f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(tell, r)) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got)
    assert rows(got, columns) == rows(want, columns)
