"""Column expressions on aligned reads: flags, CIGAR, qualities, bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# SAM flag bits and CIGAR operations.
PAIRED, PROPER_PAIR, UNMAP, MATE_UNMAP, REVERSE, MATE_REVERSE = 1, 2, 4, 8, 16, 32
READ1, READ2, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 64, 128, 256, 512, 1024, 2048
CIGAR_PATTERN = r"(\d+)([MIDNSHP=X])"
ON_READ = ("M", "I", "S", "=", "X")
ON_REFERENCE = ("M", "D", "N", "=", "X")
ALIGNED = ("M", "=", "X")

#: Which flags a strand asks for and excludes.
STRANDS = {
    "both": (0, UNMAP | SECONDARY | DUPLICATE),
    "forward": (0, UNMAP | SECONDARY | DUPLICATE | REVERSE),
    "reverse": (REVERSE, UNMAP | SECONDARY | DUPLICATE),
}


def has_flag(flag: Column, bits: int) -> Column:
    """Any of ``bits`` is set."""
    return flag.bitwiseAND(F.lit(bits)) != 0


def read_filter(strand: str = "both", mapping_quality: int = 30, ignore_chimeric: bool = True) -> Column:
    """Reads of a strand that map well enough and once."""
    wanted, unwanted = STRANDS[strand]
    keep = (F.col("flag").bitwiseAND(F.lit(unwanted)) == 0) & (F.col("mapq") >= mapping_quality)
    if wanted:
        keep = keep & (F.col("flag").bitwiseAND(F.lit(wanted)) == wanted)
    return keep & ~F.col("has_sa") if ignore_chimeric else keep


def cigar_elements(cigar: Column) -> Column:
    """array<struct<op, len>> of a CIGAR text; empty for ``*``."""
    part = lambda i: F.regexp_extract_all(cigar, F.lit(CIGAR_PATTERN), F.lit(i))
    return F.zip_with(part(2), part(1), lambda op, n: F.struct(op.alias("op"), n.cast("int").alias("len")))


def cigar_text(elements: Column) -> Column:
    return F.array_join(F.transform(elements, lambda e: F.concat(e["len"].cast("string"), e["op"])), "")


def _length(elements: Column, ops: tuple[str, ...]) -> Column:
    return F.aggregate(elements, F.lit(0), lambda n, e: n + F.when(e["op"].isin(*ops), e["len"]).otherwise(0))


def aligned_length(elements: Column) -> Column:
    """Reference bases that a read spans."""
    return _length(elements, ON_REFERENCE)


def chunks(elements: Column, pos: Column) -> Column:
    """Each CIGAR element with the 1-based read and reference positions where it starts, in one pass."""
    done = F.array().cast("array<struct<op:string,len:int,read_pos:int,ref_pos:int>>")
    start = F.struct(F.lit(1).alias("read_pos"), pos.cast("int").alias("ref_pos"), done.alias("done"))

    def step(s: Column, e: Column) -> Column:
        here = F.struct(e["op"].alias("op"), e["len"].alias("len"), s["read_pos"].alias("read_pos"), s["ref_pos"].alias("ref_pos"))
        after = lambda p, ops: (s[p] + F.when(e["op"].isin(*ops), e["len"]).otherwise(0)).alias(p)
        return F.struct(after("read_pos", ON_READ), after("ref_pos", ON_REFERENCE), F.concat(s["done"], F.array(here)).alias("done"))

    return F.aggregate(elements, start, step, lambda s: s["done"])


def error_probability(q: Column) -> Column:
    """Of a Phred score; no base is worse than a guess."""
    return F.least(F.pow(F.lit(10.0), -q / 10.0), F.lit(0.75))


def region_bin(start: Column, end: Column) -> Column:
    """Smallest bin of the six-level binning scheme that holds a 1-based closed interval."""
    s, e = start - 1, end - 1
    level = lambda shift: F.shiftright(s, shift) == F.shiftright(e, shift)
    out = F.lit(0)
    for shift, offset in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = F.when(level(shift), F.shiftright(s, shift) + offset).otherwise(out)
    return out


def region_bins(start: Column, end: Column) -> Column:
    """All bins that may hold reads overlapping a 1-based closed interval."""
    s, e = start - 1, end - 1
    levels = [F.sequence(F.shiftright(s, shift) + offset, F.shiftright(e, shift) + offset) for shift, offset in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681))]
    return F.flatten(F.array(F.array(F.lit(0)), *levels))


def tag_texts() -> Column:
    """The tags of a read as SAM text, in their order; whole numbers of all widths are ``i``."""
    return F.transform(F.map_entries("tags"), lambda t: F.concat(t["key"], F.lit(":"), t["value"]))


def sam_line(tags: bool = False) -> Column:
    """SAM text of a read of the ``reads`` schema, with its tags if asked."""
    mate = F.when(F.col("next_ref_id") < 0, "*").when(F.col("next_ref_id") == F.col("ref_id"), "=").otherwise(F.col("next_ref_name"))
    quality = F.array_join(F.transform("qual", lambda q: F.char(q.cast("int") + 33)), "")
    star = lambda c: F.when(F.length(c) == 0, "*").otherwise(c)
    fields = ["qname", "flag", "ref_name", "pos", "mapq", star(F.col("cigar")), mate, "next_pos", "tlen", star(F.col("seq")), quality]
    texts = [(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]
    return F.concat_ws("\t", *texts, *([tag_texts()] if tags else []))
