import gzip
import struct
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from swarmlake.functions import reads as R
from swarmlake.operators import annotation, pileup
from swarmlake.plans import adapters
from swarmlake.sources import bam, text
from swarmlake.streaming import pileup as streaming

SEQ = "ACGTAACCGGTTAAACCCGGGTTTAAAACCCCGGGGTTTTAAAAACCCCCGGGGGTTTTTAAAAAACCCCCCGGGGGGTTTTTTGTCACATTAT"
QUAL = "".join(chr(33 + q) for q in range(94))
CIGAR = "20S10M1I9M2D10M3X7=10M4P24M10H"
LINE = "\t".join(["TheReadName", "1536", "TheChrName", "1234", "14", CIGAR, "*", "0", "0", SEQ, QUAL])
TAGS = ["NH:i:1", "CC:Z:AnotherChr", "CP:i:6789"]


def record(pos=1234, name="TheReadName", flag=1536):
    import re

    ops = [(int(n) << 4) | bam.OPS.index(o) for n, o in re.findall(r"(\d+)(.)", CIGAR)]
    packed = bytes((bam.LETTERS.index(a) << 4) | bam.LETTERS.index(b) for a, b in zip(SEQ[::2], SEQ[1::2]))
    data = struct.pack("<iiIIiiii", 0, pos - 1, (0x1249 << 16) | (14 << 8) | (len(name) + 1), (flag << 16) | len(ops), len(SEQ), -1, -1, 0)
    data += name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + bytes(range(94))
    data += b"NHC\1" + b"CCZAnotherChr\0" + b"CPS" + struct.pack("<H", 6789)
    return struct.pack("<i", len(data)) + data


def block(data):
    packed = zlib.compressobj(wbits=-15)
    body = packed.compress(data) + packed.flush()
    return b"\x1f\x8b\x08\x04" + b"\0" * 6 + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def write_bam(path: Path, records, cut=300):
    header = b"@HD\tVN1.3\n"
    name = b"TheChrName\0"
    data = b"BAM\1" + struct.pack("<i", len(header)) + header + struct.pack("<ii", 1, len(name)) + name + struct.pack("<i", 1_000_000) + b"".join(records)
    blocks = [block(data[i : i + cut]) for i in range(0, len(data), cut)]
    path.write_bytes(b"".join(blocks) + block(b""))
    assert gzip.decompress(path.read_bytes()) == data
    starts, at = [], 0
    for b in blocks:
        starts.append(at)
        at += len(b)
    first = len(data) - sum(map(len, records))
    return [((starts[o // cut] << 16) | o % cut) for o in (first + sum(map(len, records[:k])) for k in range(len(records) + 1)) if o < len(data)]


def test_bam_and_sam(spark, tmp_path):
    spark.dataSource.register(bam.BamDataSource)
    write_bam(tmp_path / "one.bam", [record()])
    df = spark.read.format("bam").load(str(tmp_path / "one.bam"))
    assert df.select(R.sam_line().alias("s")).first()["s"] == LINE
    row = df.select("bin", "ref_id", "next_pos", text.tag_int("NH").alias("nh"), text.tag_int("CP").alias("cp"), text.tag_value("CC", "Z").alias("cc"), text.tag_int("AA").alias("aa")).first()
    assert tuple(row) == (0x1249, 0, 0, 1, 6789, "AnotherChr", None)
    (tmp_path / "one.sam").write_text("@HD\tVN1.3\n@SQ\tSN:TheChrName\tLN:1000000\n" + "\t".join([LINE, *TAGS]) + "\n")
    same = ["qname", "flag", "ref_name", "pos", "mapq", "cigar", "seq", "qual", "tags", "has_sa"]
    assert text.read_sam(spark, str(tmp_path / "one.sam")).select(*same).first() == df.select(*same).first()


def test_bam_regions(spark, tmp_path):
    spark.dataSource.register(bam.BamDataSource)
    places = [1, 500, 20_000, 60_000]
    at = write_bam(tmp_path / "many.bam", [record(p, f"r{p}", 0) for p in places])
    ends = [*at[1:], (tmp_path / "many.bam").stat().st_size << 16]
    region = {"ref": "TheChrName", "start": 520, "end": 20_010}
    want = {"r500", "r20000"}
    scan = lambda: {r["qname"] for r in spark.read.format("bam").options(**region).load(str(tmp_path)).collect()}
    assert scan() == want
    bins = {4681: [(at[0], ends[1])], 4682: [(at[2], ends[2])], 4684: [(at[3], ends[3])]}
    index = b"BAI\1" + struct.pack("<ii", 1, len(bins)) + b"".join(struct.pack("<Ii", b, len(c)) + b"".join(struct.pack("<QQ", *x) for x in c) for b, c in bins.items()) + struct.pack("<i", 0)
    (tmp_path / "many.bam.bai").write_bytes(index)
    assert scan() == want
    assert spark.read.format("bam").options(ref="None").load(str(tmp_path)).count() == 0
    assert spark.read.format("bam").load(str(tmp_path)).count() == 4


def test_fasta_in_splits(spark, tmp_path):
    """Records of all lengths, a split at every few bytes: the same records and numbers as of the whole file."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    long = [(f"r{i} > x", "ACGTN"[i % 5] * (i * 7 % 90)) for i in range(40)]
    lines = lambda s: "".join(s[i : i + 20].lower() + "\r\n" for i in range(0, len(s), 20))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fasta").write_bytes("".join(f">{n}\r\n{lines(s)}" for n, s in long).encode())
    (tmp_path / "in" / "b.fasta").write_text("no record\n>one\nac\n>\n\n>>two\nGT")
    (tmp_path / "in" / "c.fasta").write_text("")
    try:
        for size in (7, 64, 1 << 20):
            for k in kept:
                spark.conf.set(k, size)
            rows = sorted(tuple(r) for r in text.read_fasta(spark, str(tmp_path / "in")).collect())
            assert rows == [("a.fasta", i, n, s) for i, (n, s) in enumerate(long, 1)] + [("b.fasta", 1, "one", "AC"), ("b.fasta", 2, "", ""), ("b.fasta", 3, ">two", "GT")]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">CVB3 x\nacgt\nACGT\n>two\nGG\n")
    df = text.read_fasta(spark, str(tmp_path / "a.fasta"))
    assert [(r["seq_idx"], r["ref_name"], r["sequence"]) for r in df.orderBy("seq_idx").collect()] == [(1, "CVB3 x", "ACGTACGT"), (2, "two", "GG")]
    text.write_fasta(df, str(tmp_path / "out"))
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part*")) == ">CVB3 x\nACGTACGT\n>two\nGG\n"


def test_logs_metadata_and_samples(spark, tmp_path):
    (tmp_path / "run.log").write_text('x\nAssigned reference "WT.fasta" to sample "s1".\nWARNING: s1 is closer to reference "Stop.fasta" than to reference "WT.fasta".\n')
    assert [tuple(r) for r in text.assigned_references(spark, str(tmp_path / "run.log")).collect()] == [("s1", "WT")]
    assert [tuple(r) for r in text.closer_references(spark, str(tmp_path / "run.log")).collect()] == [("s1", "Stop", "WT")]
    (tmp_path / "m.csv").write_text("SampleID,Dose,Passage\na,NA,1\nb,,2\n")
    assert [tuple(r) for r in text.read_metadata(spark, str(tmp_path / "m.csv"), "m").orderBy("Passage").collect()] == [("a", None, 1, "m"), ("b", None, 2, "m")]
    paths = spark.createDataFrame([("/d/s1_S3_L002_R1_001.fastq.gz",), ("/d/s1_S3_L001_R1_001.fastq.gz",), ("/d/other.txt",)], "path string")
    assert [(r["sample"], len(r["files"])) for r in text.samples_of_reads(paths).collect()] == [("s1_S3", 2)]


def test_swarm_files(spark, tmp_path):
    cells = spark.createDataFrame([(1, 5, "AAA", 0.5), (2, 5, "AAC", 1.0)], "sample_id long, position int, codon string, freq double")
    text.save_swarm(cells, str(tmp_path / "swarm"))
    assert [r["codon"] for r in text.load_swarm(spark, str(tmp_path / "swarm"), [2]).collect()] == ["AAC"]


def test_streamed_counts_equal_batch(spark, tmp_path):
    reads = adapters.reads(spark, "/root/testdata/sf0.001")
    reads.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streaming.arriving(spark, str(tmp_path / "in"), reads.schema, files_per_trigger=1)
    streaming.counting(stream, "streamed", str(tmp_path / "state")).awaitTermination()
    batch = pileup.codon_counts(reads, threshold=30)
    assert batch.exceptAll(spark.table("streamed").select(*batch.columns)).count() == 0
    assert spark.table("streamed").count() == batch.count()
    assert spark.table("streamed").agg(F.sum("n")).first() == batch.agg(F.sum("n")).first()


def test_sam_tags(spark, tmp_path):
    spark.dataSource.register(bam.BamDataSource)
    write_bam(tmp_path / "one.bam", [record()])
    df = spark.read.format("bam").load(str(tmp_path / "one.bam"))
    assert df.select(R.sam_line(tags=True).alias("s")).first()["s"] == "\t".join([LINE, *TAGS])
    many = [f"{a}{b}:i:{ord(a) * ord(b)}" for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghij" for b in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]
    (tmp_path / "many.sam").write_text("\t".join([LINE, *many]) + "\n" + LINE + "\n")
    assert sorted(r["n"] for r in text.read_sam(spark, str(tmp_path / "many.sam")).select(F.size("tags").alias("n")).collect()) == [0, len(many)]


def test_folders(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "empty.bam").write_text("")
    for name in ("s1_S3.bam", "s2_S14.bam", "control.bam", "s1_S3.bam.bai", "x.txt"):
        (tmp_path / "in" / name).write_text("x")
    folder = str(tmp_path / "in")
    assert {r["sample"] for r in text.aligned_samples(spark, folder).collect()} == {"s1_S3", "s2_S14", "control"}
    (tmp_path / "run.log").write_text('Assigned reference "WT.fasta" to sample "s1_S3".\n')
    template = text.metadata_template(spark, folder, str(tmp_path / "run.log"), exclude="^control")
    assert sorted(map(tuple, template.collect())) == [("s1_S3", 3, "WT"), ("s2_S14", 14, None)]
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "a.csv").write_text("SampleID,Dose\na,1\nb,2\n")
    (tmp_path / "meta" / "B.CSV").write_text("SampleID,Dose,Mutagen\nc,high,RBV\n")
    found = text.read_metadata_folder(spark, str(tmp_path / "meta"), lambda df: df.filter("SampleID <> 'b'"))
    assert sorted((r["SampleID"], r["Dose"], r["Mutagen"], r["metadata_id"]) for r in found.collect()) == [("a", "1", None, "a.csv"), ("c", "high", "RBV", "B.CSV")]
    (tmp_path / "f.csv").write_text("Feature,Start,End,Segment\n2A,10, 18,seg\n")
    assert [tuple(r)[:4] for r in text.read_features(spark, str(tmp_path / "f.csv")).collect()] == [("2A", 10, 18, "seg")]
    (tmp_path / "WT.fasta").write_text(">seg\nacgta\n")
    genomes = text.reference_genomes(spark, str(tmp_path), ["WT"])
    assert [(r["genome"], r["ref_name"], r["sequence"]) for r in genomes.collect()] == [("WT", "seg", "ACGTA")]
    sites = spark.range(1, 6).selectExpr("'seg' ref_name", "cast(id as int) position")
    codons = text.consensus_codons(genomes, sites)
    assert [r["consensus"] for r in codons.orderBy("position").collect()] == ["ACG", "CGT", "GTA", "TAN", "ANN"]
    with pytest.raises(Exception, match="differ at seg"):
        text.consensus_codons(genomes, sites.filter("position < 5")).collect()


def test_swarm_sets(spark, tmp_path):
    cells = spark.createDataFrame([(1, 0, 5, "AAA", 0.5), (2, 0, 5, "AAC", 1.0)], "sample_id long, ref_id long, position int, codon string, freq double")
    sites = spark.createDataFrame([(1, 0, 5, 40), (2, 0, 5, 9)], "sample_id long, ref_id long, position int, coverage long")
    notes = spark.createDataFrame([(1, "RBV")], "sample_id long, mutagen string")
    path = lambda name: str(tmp_path / name)
    text.save_swarm_set(path("a"), cells.filter("sample_id = 1"), sites.filter("sample_id = 1"), notes)
    text.save_swarm_set(path("b"), cells.filter("sample_id = 2"), sites.filter("sample_id = 2"))
    found = text.load_swarm_set(spark, [path("a"), path("b")]).select("sample_id", "codon", "freq", "coverage", "mutagen")
    assert sorted(map(tuple, found.collect())) == [(1, "AAA", 0.5, 40, "RBV"), (2, "AAC", 1.0, 9, None)]
    with pytest.raises(ValueError, match="several"):
        text.load_swarm_set(spark, [path("a"), path("a")])
    text.save_swarm_set(path("c"), cells.drop("freq"), sites)
    with pytest.raises(ValueError, match="freq"):
        text.load_swarm_set(spark, [path("c")])


def many(n):
    return [record(1000 + 7 * i, f"read{i:04d}", i % 900) for i in range(n)]


@pytest.mark.parametrize("cut, step", [(300, 997), (5000, 1500), (64_000, 100)])
def test_bam_in_splits(spark, tmp_path, cut, step):
    """One file in many tasks gives the reads of one task."""
    spark.dataSource.register(bam.BamDataSource)
    write_bam(tmp_path / "many.bam", many(300), cut)
    whole = spark.read.format("bam").load(str(tmp_path / "many.bam"))
    parts = spark.read.format("bam").option("splitBytes", step).load(str(tmp_path / "many.bam"))
    assert whole.rdd.getNumPartitions() == 1 and parts.rdd.getNumPartitions() > 4
    names = [r["qname"] for r in parts.select("qname").collect()]
    assert names == [r["qname"] for r in whole.select("qname").collect()] == [f"read{i:04d}" for i in range(300)]


@pytest.mark.parametrize("cut", [77, 300, 2000])
def test_first_record_of_any_place(tmp_path, cut):
    """Looked for from a little before, the first record is that of the file's own order."""
    where = write_bam(tmp_path / "x.bam", many(80), cut)
    size = (tmp_path / "x.bam").stat().st_size
    refs = [("TheChrName", 1_000_000)]
    with open(tmp_path / "x.bam", "rb") as handle:
        for begin in range(0, size, 131):
            for back in (200, 1500):
                inside = [v for v in where[:80] if begin <= v >> 16 < begin + 400]
                got = bam.first_record(handle, begin, begin + 400, size, where[0], refs, back)
                assert got == min(inside, default=None) or (begin <= where[0] >> 16 and got == where[0])


def test_record_that_holds_a_record(tmp_path):
    """Bytes like records in the qualities lead to no wrong start."""
    fake = record(50, "fake") * 3
    inner = struct.pack("<iiIIiiii", 0, 99, (14 << 8) | 5, 0, len(fake), -1, -1, 0) + b"real\0" + b"\x11" * ((len(fake) + 1) // 2) + fake
    rows = [struct.pack("<i", len(inner)) + inner] * 40
    where = write_bam(tmp_path / "f.bam", rows, 700)
    size = (tmp_path / "f.bam").stat().st_size
    with open(tmp_path / "f.bam", "rb") as handle:
        for begin in range(200, size, 250):
            got = bam.first_record(handle, begin, begin + 250, size, where[0], [("TheChrName", 1_000_000)], 400)
            assert got == min((v for v in where[:40] if begin <= v >> 16 < begin + 250), default=None)


def test_cut_bam_raises(tmp_path):
    """A file cut anywhere, or with a byte changed in a block, is refused."""
    write_bam(tmp_path / "x.bam", many(4), 300)
    data = (tmp_path / "x.bam").read_bytes()
    assert len(list(read_directly(tmp_path / "x.bam"))) == 4
    for n in [*range(len(data) - 60, len(data)), *range(0, len(data) - 60, 97)]:
        (tmp_path / "cut.bam").write_bytes(data[:n])
        with pytest.raises(ValueError):
            list(read_directly(tmp_path / "cut.bam"))
    for n in range(200, len(data) - 28, 41):
        (tmp_path / "cut.bam").write_bytes(data[:n] + bytes([data[n] ^ 1]) + data[n + 1 :])
        with pytest.raises((ValueError, zlib.error)):
            list(read_directly(tmp_path / "cut.bam"))


def read_directly(path):
    reader = bam.BamReader({"path": str(path)})
    return [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]


def test_features_of_several_ranges(spark, tmp_path):
    (tmp_path / "f.csv").write_text('Feature,Start,End,Segment\nspliced,"1,20","6,28",s1\nplain,4,9,s2\n')
    features = text.read_features(spark, str(tmp_path / "f.csv"))
    assert [tuple(r) for r in features.select("feature", "start", "end", "segment").orderBy("row_no", "start").collect()] == [("spliced", 1, 6, "s1"), ("spliced", 20, 28, "s1"), ("plain", 4, 9, "s2")]
    got = sorted((r["feature"], r["codon_no"], r["position"]) for r in annotation.codon_starts(features).collect())
    assert got == [("plain", 1, 4), ("plain", 2, 7), ("spliced", 1, 1), ("spliced", 2, 4), ("spliced", 3, 20), ("spliced", 4, 23), ("spliced", 5, 26)]
