from collections import Counter
from pathlib import Path

import pytest

from swarmlake.llm.queries import ORACLE_SQL
from tests.llm.test_text_operators import brute_kept

corpus_pipeline = pytest.importorskip("corpus_pipeline")
AT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(AT).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def staged(spark):
    """What each stage takes and gives, over the smallest tables."""
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, AT).cache()
        out.append((name, docs, after))
        docs = after
    return out


def rows(df):
    return Counter(map(tuple, df.select("doc_id", "text", "lang", "source", "n_chars").collect()))


def test_stages_keep_rows_as_they_are(staged):
    assert [n for n, _, _ in staged] == ["quality classifier", "quality rules", "near-duplicates", "best-fit packing"]
    for _, before, after in staged[:-1]:
        assert after.columns == before.columns and not rows(after) - rows(before)
        assert 0 < after.count() <= before.count()
    assert staged[2][2].count() < staged[0][1].count()


def test_rules_against_sql(staged):
    duckdb = pytest.importorskip("duckdb")
    _, before, after = staged[1]
    con = duckdb.connect()
    con.register("documents", before.toPandas())
    kept = con.sql(f"SELECT doc_id FROM ({ORACLE_SQL['op3_quality_cascade']}) WHERE kept").fetchall()
    assert Counter(i for (i,) in kept) == Counter(r["doc_id"] for r in after.select("doc_id").collect())


def test_near_duplicates_against_all_pairs(staged):
    _, before, after = staged[2]
    assert Counter(r["doc_id"] for r in after.collect()) == brute_kept([(r["doc_id"], r["text"]) for r in before.collect()])


def test_packing_holds_each_document_once(staged):
    import public_tokenizers
    from tokenizers import Tokenizer

    _, before, after = staged[3]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r["doc_id"]: len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in before.collect()}
    got, sequences = Counter(), {}
    for r in after.collect():
        got[r["doc_id"]] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == Counter(want)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_and_other_partitions(spark, staged):
    """The whole run gives the packing of the stages, and what the filtering stages keep does not depend on partitions."""
    spread = lambda df: Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert spread(corpus_pipeline.run(spark, AT)) == spread(staged[3][2])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        for (_, docs, after), (_, stage) in list(zip(staged, corpus_pipeline.STAGES))[:-1]:
            assert rows(stage(spark, docs.repartition(7), AT)) == rows(after)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
