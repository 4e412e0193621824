"""The engine's queries over the driver's tables, each on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import reads as R
from ..functions import sequences as S
from ..operators import annotation, clustering, consensus, decomposition, frequency, isotonic, landmarks, manifold, metadata, mixture, models, pileup, series, swarm
from ..sources import text
from . import adapters as A
from .tables import materialized, new_path

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Reads


@query
def cigar_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = pileup.walk(A.reads(spark, sf_dir))
    return chunks.groupBy("ref_id", "cigar", "op", "read_pos", (F.col("ref_pos") - F.col("pos")).alias("ref_offset")).agg(F.count("*").alias("n"), F.sum("ref_pos").alias("sum_ref_pos"))


@query
def aligned_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = R.aligned_length(R.cigar_elements(F.col("cigar")))
    reads = A.reads(spark, sf_dir).withColumn("span", length).withColumn("end_pos", F.col("pos") + F.col("span") - 1)
    return reads.groupBy("ref_id", "span").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("end_pos").alias("last_end"))


@query
def region_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of a reference that overlap positions 200 to 260."""
    span = R.aligned_length(R.cigar_elements(F.col("cigar")))
    hit = A.reads(spark, sf_dir).filter((F.col("ref_id") == 1) & (F.col("pos") <= 260)).filter(F.col("pos") + span - 1 >= 200)
    return hit.groupBy("pos", "cigar").agg(F.count("*").alias("n"), F.sum("mapq").cast("long").alias("sum_mapq"))


@query
def bin_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of reads scaled over a long reference."""
    start = (F.col("pos") * 16381).cast("long")
    span = R.aligned_length(R.cigar_elements(F.col("cigar"))) * 97
    bins = A.reads(spark, sf_dir).select(R.region_bin(start, start + span - 1).alias("bin"), F.size(R.region_bins(start, start + span - 1)).alias("bins"))
    return bins.groupBy("bin").agg(F.count("*").alias("n"), F.max("bins").alias("most_bins"))


@query
def flag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = A.reads(spark, sf_dir)
    counted = [F.sum(F.when(R.read_filter(s), 1).otherwise(0)).cast("long").alias(s) for s in ("both", "forward", "reverse")]
    return reads.groupBy("ref_id").agg(*counted, F.sum(R.has_flag(F.col("flag"), R.SECONDARY).cast("int")).cast("long").alias("secondary"))


# Pileup


@query
def codon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.codon_counts(A.reads(spark, sf_dir))


@query
def codon_counts_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.codon_counts(A.reads(spark, sf_dir), threshold=30)


@query
def codon_counts_unambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.unambiguous(pileup.codon_counts(A.reads(spark, sf_dir), threshold=30))


@query
def nuc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.nucleotide_counts(A.reads(spark, sf_dir), threshold=30)


@query
def read_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.coverage(A.reads(spark, sf_dir), A.reference(spark))


def _sample_sites(spark: SparkSession) -> DataFrame:
    samples = spark.range(20).select(F.col("id").alias("sample_id"), (F.col("id") % 4).alias("ref_id"))
    return samples.join(F.broadcast(A.reference(spark)), "ref_id")


@query
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.coverage(A.reads(spark, sf_dir), _sample_sites(spark), keys=("sample_id", "ref_id"))


@query
def mean_coverage_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(swarm.covered_samples(coverage_matrix(spark, sf_dir), least=20.0), "mean_coverage")


@query
def consensus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.events(A.reads(spark, sf_dir))


@query
def consensus_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.bases(consensus.events(A.reads(spark, sf_dir)), A.reference(spark))


@query
def consensus_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.sequences(consensus.events(A.reads(spark, sf_dir)), A.reference(spark))


@query
def reference_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consensus of each reference's reads against all references."""
    found = consensus_sequence(spark, sf_dir).select(F.col("ref_id").alias("sample_id"), "ref_id", "sequence")
    rows = A.reference(spark).groupBy("ref_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "base"))), lambda p: p["base"]), "").alias("sequence"))
    return consensus.closest_references(found, rows)


@query
def codon_freq_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pileup.naive_frequencies(pileup.codon_counts(A.reads(spark, sf_dir), threshold=30)), "freq")


@query
def codon_freq_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frequency.estimated(pileup.unambiguous(pileup.codon_counts(A.reads(spark, sf_dir), threshold=30)))
    return rounded(frequency.at_all_sites(found, A.reference(spark)).drop("residual"), "freq")


@query
def nuc_freq_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base frequencies at every site of each reference."""
    found = frequency.estimated(pileup.nucleotide_counts(A.reads(spark, sf_dir), threshold=30), list(S.BASES), seen="nuc")
    return rounded(frequency.at_all_sites(found, A.reference(spark)).drop("residual"), "freq")


# Files


@query
def read_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors to expect in the reads of each sample and reference, by their qualities."""
    errors = F.aggregate(F.transform("qual", R.error_probability), F.lit(0.0), lambda s, p: s + p)
    found = A.reads(spark, sf_dir).groupBy("sample_id", "ref_id").agg(F.count("*").alias("n_reads"), F.avg(errors).alias("errors"))
    return rounded(found, "errors")


@query
def sam_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reads as SAM text with two tags, and read again."""
    lit = lambda v, c: F.lit(v).alias(c)
    tags = F.create_map(F.lit("NM"), F.concat(F.lit("i:"), F.col("mapq") % 7), F.lit("RG"), F.concat(F.lit("Z:s"), "sample_id"))
    lines = A.reads(spark, sf_dir).select(
        F.concat_ws("-", F.lit("r"), "sample_id", "seq").alias("qname"), "flag", "ref_id", F.concat(F.lit("ref"), "ref_id").alias("ref_name"), "pos", "mapq", "cigar",
        lit(-1, "next_ref_id"), lit("", "next_ref_name"), lit(0, "next_pos"), lit(0, "tlen"), "seq", "qual", tags.alias("tags"),
    )
    path = new_path(spark)
    lines.select(R.sam_line(tags=True)).write.text(path)
    q = F.aggregate("qual", F.lit(0).cast("long"), lambda s, v: s + v)
    return text.read_sam(spark, path).select("qname", "flag", "ref_name", "pos", "mapq", "cigar", "next_ref_name", "seq", q.alias("qualities"), text.tag_int("NM").alias("nm"), text.tag_value("RG", "Z").alias("rg"))


@query
def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence for each part, as FASTA files in order, and read again."""
    key = F.col("p_partkey").cast("string")
    bases = F.translate(F.repeat(F.md5(key.cast("binary")), 3), "0123456789abcdef", "acgt" * 4)
    path = new_path(spark)
    text.write_fasta(A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq_idx"), F.concat(F.lit("part"), key, F.lit(" "), "p_name").alias("ref_name"), bases.alias("sequence")), path, one_file=False)
    return text.read_fasta(spark, path).select("ref_name", "sequence")


@query
def swarm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies, complete codons at each site and a note for each sample, saved as a set and loaded, with the same sites."""
    keys = ["sample_id", "ref_id", "position"]
    cells = materialized(pileup.naive_frequencies(pileup.codon_counts(A.reads(spark, sf_dir), threshold=30, keys=("sample_id", "ref_id")), ("sample_id", "ref_id")))
    sites = cells.groupBy(*keys).agg(F.sum("n").alias("coverage"))
    notes = cells.select("sample_id").distinct().withColumn("note", F.concat(F.lit("sample "), "sample_id"))
    path = new_path(spark)
    text.save_swarm_set(path, cells.drop("n"), sites, notes)
    loaded = text.load_swarm_set(spark, [path])
    metadata.check_same_sites(loaded, sites, keys)
    return rounded(loaded.select(F.col("sample_id").cast("long").alias("sample_id"), "ref_id", "position", "codon", "freq", "coverage", "note"), "freq")


# Swarms


def _swarm(spark: SparkSession, sf_dir: str, strand: str = "both") -> DataFrame:
    keys = ("sample_id", "ref_id")
    return pileup.naive_frequencies(pileup.codon_counts(A.reads(spark, sf_dir), threshold=30, keys=keys, strand=strand), keys).drop("n")


@query
def swarm_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = swarm.select(_swarm(spark, sf_dir), F.col("position").between(100, 160), F.col("codon").isin("AAA", "CCC", "ACG"), ~(F.col("sample_id") == 3))
    return rounded(cells, "freq")


@query
def swarm_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = swarm.concat([_swarm(spark, sf_dir, s).withColumn(s, F.lit(True)) for s in ("forward", "reverse")])
    return rounded(both.groupBy("sample_id").agg(F.count("forward").alias("forward_cells"), F.count("reverse").alias("reverse_cells"), F.sum("freq").alias("mass")), "mass", digits=4)


@query
def swarm_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = S.translated(swarm.annotate(_swarm(spark, sf_dir), annotation.reference_codons(A.reference(spark)), ["ref_id", "position"]), "codon")
    return rounded(named.groupBy("sample_id", "amino_acid").agg(F.count("*").alias("cells"), F.sum((F.col("codon") == F.col("ref_codon")).cast("int")).cast("long").alias("as_reference"), F.sum("freq").alias("mass")), "mass", digits=4)


@query
def swarm_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(swarm.consensus(_swarm(spark, sf_dir)), "freq")


@query
def consensus_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = swarm.consensus_one_hot(_swarm(spark, sf_dir))
    return hot.groupBy("ref_id", "position").agg(F.sum("one_hot").cast("long").alias("hot"), F.count("*").alias("cells"))


@query
def center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(swarm.centred(_swarm(spark, sf_dir), 20).drop("freq"), "centred")


@query
def variance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(swarm.variable(_swarm(spark, sf_dir), 20, least=0.5), "mean", "sd")


def _lod(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = A.reads(spark, sf_dir).withColumn("reverse", F.col("flag").bitwiseAND(16) > 0)
    counts = pileup.codon_counts(reads, threshold=30, keys=("sample_id", "ref_id", "reverse"))
    return swarm.detection_limit(*swarm.by_strand(counts, ("sample_id", "ref_id")), run=F.col("sample_id") % 2)


@query
def lod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_lod(spark, sf_dir), "lod")


@query
def log_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = _swarm(spark, sf_dir).groupBy("ref_id", "position", "codon").agg((F.min("freq") / 10).alias("lod"))
    return rounded(swarm.log_transformed(_swarm(spark, sf_dir), limits).drop("freq"), "value")


@query
def sample_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mixture.estimated(_swarm(spark, sf_dir), annotation.reference_codons(A.reference(spark))), "proportion", digits=4)


@query
def purity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with over half of one reference; the adapters' reads are no real mixtures."""
    return mixture.pure(sample_mix(spark, sf_dir), least=0.5)


# Annotation and sequences


@query
def feature_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotation.codon_starts(A.features(spark, sf_dir))


@query
def feature_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = A.reference(spark).select("position").distinct()
    return annotation.feature_at(positions, A.features(spark, sf_dir))


@query
def variant_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = pileup.codon_counts(A.reads(spark, sf_dir), threshold=30).select("ref_id", "position", "codon").distinct()
    return annotation.variant_labels(variants, A.features(spark, sf_dir), A.reference(spark))


@query
def variant_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of all codons at all positions of the references that start a codon of a feature."""
    return annotation.variant_grid(A.reference(spark), A.features(spark, sf_dir))


@query
def codon_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    codons = A.reads(spark, sf_dir).select("ref_id", F.explode(S.sequence_codons(F.col("seq"))).alias("codon"))
    return S.translated(codons.groupBy("ref_id", "codon").agg(F.count("*").alias("n")), "codon").groupBy("ref_id", "amino_acid").agg(F.sum("n").alias("n"))


@query
def kmer_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character triples of all documents by language."""
    docs = A.table(spark, sf_dir, "documents").filter("text is not null").select("lang", F.explode(S.sequence_codons(F.col("text"))).alias("kmer"))
    return docs.groupBy("lang", "kmer").agg(F.count("*").alias("n"))


@query
def lev_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit and Hamming distance of each part's type to its brand."""
    parts = A.table(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_type", "p_brand").alias("edits"), S.hamming(F.col("p_name"), F.reverse("p_name")).alias("mismatches"))
    return parts


@query
def weighted_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance with dear gaps of each part's type to its brand."""
    return A.table(spark, sf_dir, "part").select("p_partkey", S.weighted_levenshtein(F.col("p_type"), F.col("p_brand"), 10, 10, 1).alias("cost"))


# Time series

IDS = ["user_id", "event_type"]


@query
def ts_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.at_steps(A.series(spark, sf_dir), IDS, 86400.0), "v", digits=4)


@query
def ts_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.means(A.series(spark, sf_dir), IDS), "mean", digits=4)


@query
def ts_median_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.median_filtered(A.series(spark, sf_dir), IDS), "v")


STRETCH = 7 * 86400.0


def _of(series_: DataFrame, event_type: str) -> DataFrame:
    return series_.filter(F.col("event_type") == event_type).drop("event_type")


@query
def ts_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's clicks at the times of the views, clamped."""
    values, asked = _of(A.series(spark, sf_dir), "click"), _of(A.series(spark, sf_dir), "view").select("user_id", "t")
    return rounded(series.values_at(values, asked, ["user_id"], clamp=True, width=STRETCH), "value")


def _path_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.distance_curve(A.paths(spark, sf_dir), ["user_id"], "event_type", "click", "view")


@query
def path_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance curve of two paths in two dimensions."""
    return rounded(_path_curve(spark, sf_dir), "c", "b", "a")


@query
def curve_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of two paths at the times of a third series."""
    asked = _of(A.series(spark, sf_dir), "purchase").select("user_id", "t")
    return rounded(series.curve_values(_path_curve(spark, sf_dir), asked, ["user_id"], STRETCH), "distance")


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.distance_curve(A.series(spark, sf_dir), ["user_id"], "event_type", "click", "view")


@query
def distance_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_curve(spark, sf_dir).drop("a", "b"), "c", digits=2)


@query
def bifurcation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.bifurcations(_curve(spark, sf_dir), ["user_id"], 10.0), "t", digits=0)


@query
def curve_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.curve_means(_curve(spark, sf_dir), ["user_id"]), "mean", digits=2)


# Models


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = A.points(spark, sf_dir)
    return models.to_centres(points, models.centres(points))


@query
def sq_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_distances(spark, sf_dir).select("vec_id", "centre", "d2"), "d2")


@query
def nn_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.nearest(_distances(spark, sf_dir)), "predicted")


@query
def gks_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.kernel_smoothed(_distances(spark, sf_dir), 0.2), "predicted")


@query
def nn_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitness of the nearest other point, for every fiftieth point against all."""
    points = A.points(spark, sf_dir)
    return rounded(models.nearest_of_all(points.filter("vec_id % 50 = 0"), points), "d2", "predicted")


@query
def gks_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel prediction from all other points, for every fiftieth point."""
    points = A.points(spark, sf_dir)
    return rounded(models.smoothed_by_all(points.filter("vec_id % 50 = 0"), points, 0.2), "predicted")


@query
def kernel_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.kernel_errors(A.points(spark, sf_dir), _distances(spark, sf_dir), [0.05, 0.1, 0.2, 0.4, 0.8]), "mse", digits=5)


SIGMAS = [0.1, 0.2, 0.4, 0.8]


@query
def kernel_width_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of each width over random splits of all points."""
    return rounded(models.split_errors(A.points(spark, sf_dir), SIGMAS, splits=8), "mse")


@query
def kernel_width_without_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best width for each point when it is left out."""
    return rounded(models.widths_without_one(A.points(spark, sf_dir), SIGMAS, splits=4), "mse")


@query
def loo_nn_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point from its nearest other one."""
    points = A.points(spark, sf_dir)
    return rounded(models.nearest_of_all(points, points), "d2", "predicted")


@query
def loo_gks_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point from all others by the kernel."""
    points = A.points(spark, sf_dir)
    return rounded(models.smoothed_by_all(points, points, 0.2), "predicted")


@query
def categorical_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's price from the parts that differ least from it."""
    parts = A.categories(spark, sf_dir)
    return rounded(models.categorical_nearest(parts, parts, [f"x{i}" for i in range(6)], "p_partkey"), "predicted")


@query
def landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitness over a grid of 50 by 50 places of the first two components, and how well points cover each."""
    plane = A.points(spark, sf_dir).select(F.col("x")[1].alias("x"), F.col("x")[2].alias("y"), "fitness")
    side = [k / 25 - 1.0 for k in range(50)]
    return rounded(models.landscape(plane, side, side, 0.1), "z", "alpha", "cover")


@query
def group_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.group_means(A.points(spark, sf_dir)), "predicted")


@query
def loo_group_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.group_means(A.points(spark, sf_dir), leave_one_out=True), "predicted")


@query
def variance_unexplained(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = A.points(spark, sf_dir)
    pairs = models.group_means(points, True).join(points.select("vec_id", F.col("fitness").alias("truth")), "vec_id")
    return rounded(models.variance_unexplained(pairs), "unexplained")


def _landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.centres(A.points(spark, sf_dir)).select(F.col("centre").alias("name"), F.col("centre_x").alias("x"))


@query
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(landmarks.nearest_graph(landmarks.distances(_landmarks(spark, sf_dir)), 3), "d")


@query
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = landmarks.nearest_graph(landmarks.distances(_landmarks(spark, sf_dir)), 3)
    return rounded(landmarks.shortest_paths(graph), "d")


def _landmark_paths(spark: SparkSession, sf_dir: str):
    """Names, points and shortest paths of the landmarks, one a label."""
    rows = _landmarks(spark, sf_dir)
    pairs = landmarks.distances(rows)
    names, full = landmarks.to_matrix(pairs)
    _, near = landmarks.to_matrix(landmarks.nearest_graph(pairs, 3))
    at = {r["name"]: r["x"] for r in rows.collect()}
    return names, [at[n] for n in names], landmarks.all_paths(landmarks.connected(near, full))


@query
def isomap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point in two dimensions, by its paths to the landmarks."""
    _, at, paths = _landmark_paths(spark, sf_dir)
    return landmarks.placed(A.points(spark, sf_dir), at, paths, landmarks.classical_scaling(paths, 2)).select("vec_id", "label", F.col("place")[0].alias("x"), F.col("place")[1].alias("y"))


@query
def kruskal_isomap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point among the landmarks of a non-metric scaling, with its stress."""
    _, at, paths = _landmark_paths(spark, sf_dir)
    x, stress = landmarks.nonmetric_scaling(paths, landmarks.classical_scaling(paths, 2))
    return landmarks.placed_among(A.points(spark, sf_dir), at, x).select("vec_id", "label", F.col("place")[0].alias("x"), F.col("place")[1].alias("y"), F.lit(stress).alias("stress"))


@query
def knn_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of the five nearest neighbours of every point."""
    return rounded(manifold.nearest_graph(manifold.Cells(manifold.nodes(A.points(spark, sf_dir))), 5), "d")


@query
def landmark_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest paths from every point to twelve landmarks over that graph, made connected."""
    cells = manifold.Cells(manifold.nodes(A.points(spark, sf_dir)))
    sources = [r["node"] for r in manifold.far_apart(cells.rows, 12)]
    found = manifold.paths(manifold.connected(manifold.nearest_graph(cells, 5), cells), cells.rows, sources)
    named = F.arrays_zip(F.array(*[F.lit(s) for s in sources]).alias("landmark"), F.col("d"))
    return rounded(found.select("node", F.explode(named).alias("p")).select("p.landmark", "node", "p.d"), "d")


@query
def isomap_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point in two dimensions by its paths over the graph of all points."""
    placed = manifold.isomap(A.points(spark, sf_dir), 5)
    return placed.select("vec_id", "label", F.col("place")[0].alias("x"), F.col("place")[1].alias("y"))


@query
def cluster_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point with the cluster of its label, of three by average linkage, named by its smallest label."""
    names, d = landmarks.to_matrix(landmarks.distances(_landmarks(spark, sf_dir)))
    of = landmarks.cut_tree(landmarks.average_linkage(d), len(names), 3)
    cluster = F.create_map(*[F.lit(x) for name, c in zip(names, of) for x in (name, names[c])])
    return A.points(spark, sf_dir).select("vec_id", "label", cluster[F.col("label")].alias("cluster"))


@query
def pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point on the two leading axes of all; the axes are as long as a point."""
    import numpy as np

    points = A.points(spark, sf_dir)
    _, vectors = np.linalg.eigh(landmarks.covariance(points))
    axes = [v * (1 if v[np.abs(v).argmax()] > 0 else -1) for v in vectors[:, :-3:-1].T]
    on = lambda axis: F.aggregate(F.zip_with("x", F.array(*[F.lit(float(a)) for a in axis]), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return points.select("vec_id", on(axes[0]).alias("first"), on(axes[1]).alias("second"))


@query
def sparse_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all points in two components of bounded L1 norm."""
    found, _ = decomposition.sparse_components(A.points(spark, sf_dir), 2, 6.0, 1e-4)
    return found.select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[1], 6).alias("second"))


@query
def submatrix_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of two axes in the squares of the points that vary most over their components."""
    return rounded(spark.createDataFrame(decomposition.submatrix_scores(A.points(spark, sf_dir), [k / 10 for k in range(10)], 2)), "score", "singular")


@query
def hclust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges of the labels' centres by average linkage."""
    return clustering.average_linkage(landmarks.distances(_landmarks(spark, sf_dir)))


@query
def hclust_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges of the part types of all brands by the mean size, price and name length of their parts."""
    parts = A.table(spark, sf_dir, "part").withColumn("name", F.concat_ws("-", "p_brand", "p_type"))
    means = parts.groupBy("name").agg(F.avg("p_size").alias("size"), F.avg(F.col("p_retailprice") / 100).alias("price"), F.avg(F.length("p_name")).alias("letters"))
    return rounded(clustering.average_linkage(landmarks.distances(means.select("name", F.array("size", "price", "letters").alias("x")))), "dist")


@query
def talus(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    values = np.linalg.eigvalsh(landmarks.covariance(A.points(spark, sf_dir)))[::-1]
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(landmarks.talus(values), 1)], "k int, drop double")


@query
def isotonic_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price in cents of each line as it never falls with quantity, by supplier and flag."""
    lines = A.table(spark, sf_dir, "lineitem").withColumn("cents", F.round(F.col("l_extendedprice") * 100))
    return isotonic.isotonic(lines, ["l_suppkey", "l_returnflag"], "l_quantity", "cents").select("l_orderkey", "l_linenumber", "fit")


# Metadata


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("sample_id"), F.col("c_mktsegment").alias("run"), F.col("c_nationkey").alias("reference"), F.col("c_custkey").alias("row"), F.col("c_acctbal").alias("dose")
    )


@query
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metadata.filtered(_metadata(spark, sf_dir), "run", ("reference", [1, 3, 5, 7]), ("dose", lambda c: c > 0), metadata.matches_any(F.col("sample_id"), ["1$", "7$"]))
    return found.select("sample_id", "run", "reference", "dose")


@query
def sample_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order of each customer."""
    orders = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("row"), "o_orderkey", "o_totalprice", F.col("o_orderkey").alias("at"))
    return metadata.lookup(_metadata(spark, sf_dir), orders, ["row"], "at").select("sample_id", "o_orderkey", "o_totalprice")


@query
def fitness_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _metadata(spark, sf_dir)
    price = F.col("o_totalprice")
    replicate = [F.when(F.col("o_orderkey") % k != 0, price / k).alias(n) for k, n in ((2, "a"), (3, "b"), (5, "c"))]
    fit = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fit_row"), F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).alias("sample_id"), (F.col("o_custkey") % 25).cast("int").alias("reference"), *replicate)
    fit = fit.select("fit_row", "sample_id", "reference", metadata.mean_of_known("a", "b", "c").alias("fitness")).filter("fitness is not null")
    found = metadata.fitness_joined(left.select("sample_id", "reference", "row"), fit, "sample_id", ["reference"], "row")
    return rounded(found, "fitness", digits=4)


@query
def lin_reg_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = A.table(spark, sf_dir, "lineitem")
    return rounded(metadata.regression(lines, "l_returnflag", "l_quantity", "l_extendedprice"), "slope", "intercept", "y1", "y2", digits=4)
