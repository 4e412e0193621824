from pyspark.sql import functions as F

from swarmlake.functions import reads as R
from swarmlake.functions import sequences as S

CIGAR = "20S10M1I9M2D10M3X7=10M4P24M10H"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_cigar_round_trip(spark):
    for text in ("1M", "10S268435455M21S", CIGAR):
        assert one(spark, R.cigar_text(R.cigar_elements(F.lit(text))).alias("c"))["c"] == text
    assert one(spark, R.cigar_elements(F.lit("*")).alias("c"))["c"] == []


def test_cigar_walk(spark):
    got = one(spark, R.chunks(R.cigar_elements(F.lit(CIGAR)), F.lit(1234)).alias("c"), R.aligned_length(R.cigar_elements(F.lit(CIGAR))).alias("n"))
    want = "S20@1,1234; M10@21,1234; I1@31,1244; M9@32,1244; D2@41,1253; M10@41,1255; X3@51,1265; =7@54,1268; M10@61,1275; P4@71,1285; M24@71,1285; H10@95,1309"
    assert "; ".join(f"{c['op']}{c['len']}@{c['read_pos']},{c['ref_pos']}" for c in got["c"]) == want
    assert got["n"] == 75


def test_error_probability(spark):
    got = one(spark, *[R.error_probability(F.lit(q)).alias(f"q{q}") for q in (0, 30, 40)])
    assert [round(x, 9) for x in got] == [0.75, 0.001, 0.0001]


def test_bins(spark):
    got = one(spark, R.region_bin(F.lit(1234), F.lit(1308)).alias("b"), R.region_bins(F.lit(1), F.lit(1)).alias("all"))
    assert got["b"] == 0x1249
    assert got["all"] == [0, 1, 9, 73, 585, 4681]


def test_codons(spark):
    got = one(spark, S.sequence_codons(F.lit("ACGTA")).alias("c"), S.sequence_codons(F.lit("AC")).alias("short"))
    assert got["c"] == ["ACG", "CGT", "GTA"] and got["short"] == []
    rows = S.translated(spark.createDataFrame([("ATG",), ("TAA",), ("NNN",), ("atg",)], "codon string"), "codon").collect()
    assert {r["codon"]: r["amino_acid"] for r in rows} == {"ATG": "M", "TAA": "*", "NNN": "?", "atg": "?"}


def test_edit_costs(spark):
    assert S.edit_cost("ACGT", "AGT", 10, 10, 1) == 10
    assert S.edit_cost("kitten", "sitting", 1, 1, 1) == 3
    assert S.edit_cost("", "ab", 2, 3, 1) == 6 and S.edit_cost("ab", "", 2, 3, 1) == 4
    got = one(spark, S.hamming(F.lit("ACGT"), F.lit("AGGA")).alias("h"), S.hamming(F.lit("A"), F.lit("AC")).alias("u"), S.hamming(F.lit(""), F.lit("")).alias("e"))
    assert (got["h"], got["u"], got["e"]) == (2, None, 0)
