"""Text sources and sinks: SAM, FASTA, logs, CSV metadata, sample names from paths."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment rows of SAM text, headers left out."""
    f = F.split("value", "\t")
    lines = spark.read.text(path).filter(~F.col("value").startswith("@"))
    at = lambda i, name, kind="string": f.getItem(i).cast(kind).alias(name)
    tags = F.map_from_entries(F.transform(F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substring(t, 4, 1 << 30).alias("v"))))
    qual = F.transform(F.split(f.getItem(10), ""), lambda c: F.ascii(c) - 33)
    return lines.select(
        at(0, "qname"), at(1, "flag", "int"), at(2, "ref_name"), at(3, "pos", "int"), at(4, "mapq", "int"), at(5, "cigar"), at(6, "next_ref_name"),
        at(7, "next_pos", "int"), at(8, "tlen", "int"), at(9, "seq"), qual.alias("qual"), tags.alias("tags"), F.map_contains_key(tags, "SA").alias("has_sa"),
    )


def tag_value(name: str, kind: str) -> Column:
    """Value of a tag held as SAM text; null if it is missing or of another type."""
    text = F.col("tags")[name]
    return F.when(F.substring(text, 1, 1) == kind, F.substring(text, 3, 1 << 30))


def tag_int(name: str) -> Column:
    return tag_value(name, "i").cast("long")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """file, seq_idx, ref_name and the sequence in capitals; seq_idx is the record's number in its file, from 1.

    Files are cut where lines start a record, so many tasks read a large one. The number
    of a record is that of the records in the splits before, and before it in its own.
    What stands before the first record is left out.
    """
    m = F.col("_metadata")
    split = [m["file_path"].alias("path"), m["file_block_start"].alias("split")]
    pieces = spark.read.text(path, lineSep="\n>").select(*split, m["file_name"].alias("file"), F.monotonically_increasing_id().alias("id"), "value")
    begins = (F.col("split") == 0) & F.min_by(F.startswith("value", F.lit(">")), "id")
    splits = pieces.groupBy("path", "split").agg(F.min("id").alias("first"), F.count("*").alias("n"), begins.alias("begins"))
    in_file = Window.partitionBy("path")
    earlier = F.coalesce(F.sum("n").over(in_file.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = splits.select("path", "split", "first", earlier.alias("earlier"), F.max("begins").over(in_file).cast("int").alias("shift"))
    placed = pieces.join(counted, ["path", "split"]).withColumn("seq_idx", (F.col("earlier") + F.col("id") - F.col("first") + F.col("shift")).cast("int")).filter("seq_idx > 0")
    head = (F.col("split") == 0) & (F.col("id") == F.col("first")) & (F.col("shift") == 1)
    record = F.when(head, F.substring("value", 2, (1 << 31) - 1)).otherwise(F.col("value"))
    name = F.regexp_extract("record", r"^([^\r\n]*)", 1)
    body = F.upper(F.regexp_replace(F.regexp_extract("record", r"(?s)^[^\r\n]*(.*)$", 1), r"\s+", ""))
    return placed.withColumn("record", record).select("file", "seq_idx", F.trim(name).alias("ref_name"), body.alias("sequence"))


def write_fasta(sequences: DataFrame, path: str, one_file: bool = True) -> None:
    """One line of sequence for each record, in the order of seq_idx; in one file, or in files whose names go on in that order."""
    records = sequences.orderBy("seq_idx").select(F.concat(F.lit(">"), "ref_name", F.lit("\n"), "sequence").alias("value"))
    (records.coalesce(1) if one_file else records).write.text(path)


def read_metadata(spark: SparkSession, path: str, name: str) -> DataFrame:
    """CSV with empty fields and NA as null, and where it comes from."""
    df = spark.read.csv(path, header=True, inferSchema=True, nullValue="NA", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    texts = [c for c, t in df.dtypes if t == "string"]
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in texts}).withColumn("metadata_id", F.lit(name))


def assigned_references(spark: SparkSession, path: str) -> DataFrame:
    """sample and reference of the log lines that assign one, file endings left out."""
    pattern = r'^Assigned reference "([^"]+)" to sample "([^"]+)"\.\s*$'
    lines = spark.read.text(path).filter(F.col("value").rlike(pattern))
    return lines.select(F.regexp_extract("value", pattern, 2).alias("sample"), F.regexp_replace(F.regexp_extract("value", pattern, 1), r"\.[^.]*$", "").alias("reference"))


def closer_references(spark: SparkSession, path: str) -> DataFrame:
    """sample, closer and assigned of the log lines that warn of a nearer reference."""
    pattern = r'^WARNING: ([^"]+) is closer to reference "([^"]+)" than to reference "([^"]+)"\.\s*$'
    lines = spark.read.text(path).filter(F.col("value").rlike(pattern))
    part = lambda i: F.regexp_replace(F.regexp_extract("value", pattern, i), r"\.[^.]*$", "")
    return lines.select(F.regexp_extract("value", pattern, 1).alias("sample"), part(2).alias("closer"), part(3).alias("assigned"))


def samples_of_reads(paths: DataFrame, pattern: str = r"^(.+)_L\d+_R1_\d+\.fastq\.gz$") -> DataFrame:
    """Files of each sample by their names, in order."""
    name = F.element_at(F.split("path", "/"), -1)
    found = paths.withColumn("sample", F.regexp_extract(name, pattern, 1)).filter("sample <> ''")
    return found.groupBy("sample").agg(F.sort_array(F.collect_list("path")).alias("files"))


def save_swarm(swarm: DataFrame, path: str) -> None:
    """By sample, so that reads of some samples touch only their files."""
    swarm.repartition("sample_id").write.partitionBy("sample_id").mode("overwrite").parquet(path)


def load_swarm(spark: SparkSession, path: str, samples: list[int] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if samples is None else df.filter(F.col("sample_id").isin(samples))


def listed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path and name of the files of a folder whose name matches; empty files are left out, contents stay unread."""
    names = spark.read.format("binaryFile").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    return names.filter(F.col("name").rlike(pattern))


def aligned_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Samples that have an alignment in a folder, by file name."""
    return listed(spark, folder, r"\.bam$").select(F.regexp_replace("name", r"\.bam$", "").alias("sample"), "path")


def read_metadata_folder(spark: SparkSession, folder: str, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The CSV files of a folder, each filtered by ``keep``, under each other; columns that a file lacks are null.

    A column whose type differs between files becomes text. Metadata files are few,
    so their names are known to the driver.
    """
    files = sorted(listed(spark, folder, r"(?i)\.csv$").collect(), key=lambda f: f["name"])
    parts = [keep(read_metadata(spark, f["path"], f["name"])) for f in files]
    if not parts:
        raise ValueError(f"no CSV files in {folder}")
    types = {}
    for name, kind in (c for p in parts for c in p.dtypes):
        types.setdefault(name, set()).add(kind)
    mixed = [name for name, kinds in types.items() if len(kinds) > 1]
    out = [p.withColumns({c: F.col(c).cast("string") for c in mixed if c in p.columns}) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """feature, start, end, segment, row_no and codons_before of a CSV with these columns, in the order of the file.

    Start and End may be lists by commas: such a feature has a row for each of its ranges,
    and ``codons_before`` counts the codons of those before. The file is read as one piece,
    since tables of features are small and their order counts.
    """
    rows = spark.read.csv(path, header=True, multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    whole = lambda c: F.transform(F.split(c, ","), lambda x: F.trim(x).cast("int"))
    named = rows.select(F.col("Feature").alias("feature"), whole("Start").alias("starts"), whole("End").alias("ends"), F.col("Segment").alias("segment"), F.monotonically_increasing_id().alias("row_no"))
    codons = F.zip_with("starts", "ends", lambda a, b: F.greatest(F.floor((b - a) / 3) + 1, F.lit(0)))
    each = named.withColumn("codons", codons).select("*", F.posexplode(F.arrays_zip("starts", "ends")).alias("piece", "r"))
    before = F.aggregate(F.slice("codons", F.lit(1), F.col("piece")), F.lit(0).cast("long"), lambda n, x: n + x)
    return each.select("feature", F.col("r.starts").alias("start"), F.col("r.ends").alias("end"), "segment", "row_no", before.cast("int").alias("codons_before"))


def reference_genomes(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """genome and the sequences of each genome's FASTA file; a name without a file is an error."""
    found = [read_fasta(spark, f"{folder.rstrip('/')}/{n}.fasta").withColumn("genome", F.lit(n)) for n in names]
    return reduce(DataFrame.unionByName, found)


def metadata_template(spark: SparkSession, folder: str, logs: str, exclude: str | None = None) -> DataFrame:
    """sample, sample number (behind ``_S`` at its end) and assigned reference of each alignment not excluded by name."""
    samples = aligned_samples(spark, folder).select("sample")
    if exclude is not None:
        samples = samples.filter(~F.col("sample").rlike(exclude))
    number = F.nullif(F.regexp_extract("sample", r"_S(\d+)$", 1), F.lit("")).cast("int")
    assigned = assigned_references(spark, logs).groupBy("sample").agg(F.min("reference").alias("reference"))
    return samples.withColumn("sample_number", number).join(assigned, "sample", "left")


def save_swarm_set(path: str, cells: DataFrame, sites: DataFrame, annotations: DataFrame | None = None) -> None:
    """A swarm as tables: ``cells`` (frequencies), ``sites`` (coverage of each position), and ``annotations`` by sample."""
    save_swarm(cells, f"{path}/cells")
    save_swarm(sites, f"{path}/sites")
    if annotations is not None:
        annotations.write.mode("overwrite").parquet(f"{path}/annotations")


def load_swarm_set(spark: SparkSession, paths: list[str], samples: list[int] | None = None) -> DataFrame:
    """Cells of some swarms with coverage and the samples' annotations.

    A swarm must have its required columns; samples in several swarms are refused.
    """
    out = []
    for path in paths:
        cells, sites = load_swarm(spark, f"{path}/cells", samples), load_swarm(spark, f"{path}/sites", samples)
        for table, required in ((cells, {"sample_id", "ref_id", "position", "freq"}), (sites, {"sample_id", "ref_id", "position", "coverage"})):
            if lacking := required - set(table.columns):
                raise ValueError(f"{path} lacks {sorted(lacking)}")
        joined = cells.join(sites, ["sample_id", "ref_id", "position"], "left")
        if listed_under(spark, path, "annotations"):
            joined = joined.join(spark.read.parquet(f"{path}/annotations"), "sample_id", "left")
        out.append(joined)
    ids = reduce(DataFrame.unionAll, [c.select("sample_id").distinct() for c in out])
    if not ids.groupBy("sample_id").count().filter("count > 1").isEmpty():
        raise ValueError("a sample is in several swarms")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def listed_under(spark: SparkSession, path: str, name: str) -> bool:
    """Whether a swarm has a table of this name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return not files.filter(F.col("path").contains(f"/{name}/")).isEmpty()


def consensus_codons(sequences: DataFrame, sites: DataFrame) -> DataFrame:
    """Codon of a consensus at each position, the end filled with N; names and lengths must be those of ``sites`` (ref_name, position)."""
    length = sites.groupBy("ref_name").agg(F.max("position").alias("length"))
    met = sequences.select("ref_name", "sequence").join(length, "ref_name", "full")
    wrong = F.concat(F.lit("consensus and sites differ at "), F.col("ref_name"))
    sound = F.coalesce(F.length("sequence") == F.col("length"), F.lit(False))
    checked = met.select("ref_name", F.when(sound, F.col("sequence")).otherwise(F.raise_error(wrong)).alias("sequence"))
    at = checked.select("ref_name", F.concat("sequence", F.lit("NN")).alias("padded"), F.explode(F.sequence(F.lit(1), F.length("sequence"))).alias("position"))
    return at.select("ref_name", "position", F.col("padded").substr(F.col("position"), F.lit(3)).alias("consensus"))
