from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry
from swarmlake.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
SOME = ["codon_counts_unambiguous", "read_coverage", "consensus_counts", "lod", "variant_labels", "bifurcation", "curve_mean", "gks_predict", "nn_samples", "gks_samples", "kmer_docs", "shortest_paths", "fitness_join", "ts_asked", "path_curve", "curve_at", "kernel_width_splits", "kernel_width_without_one", "categorical_nn", "landscape", "consensus_sequence", "weighted_edit", "knn_samples", "center", "read_errors", "sam_round_trip", "fasta_round_trip", "swarm_round_trip", "variant_grid", "isotonic_price"]


@pytest.mark.parametrize("name", SOME)
def test_query_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, DATA)
    sql = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(sql.columns)
    at = [sql.columns.index(c) for c in df.columns]
    assert Counter(map(tuple, df.collect())) == Counter(tuple(r[i] for i in at) for r in sql.fetchall())


def test_catalogue():
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
