"""The same queries as SQL for another engine."""

from __future__ import annotations

READS = """
reads AS (
  SELECT l_suppkey % 20 AS sample_id, l_suppkey % 4 AS ref_id, CAST(l_partkey % 500 + 1 AS INTEGER) AS pos,
         CAST(trunc(l_quantity) AS INTEGER) AS mapq,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 64 ELSE CASE WHEN l_partkey % 3 = 0 THEN 256 ELSE 128 END END
           + CASE WHEN l_linestatus = 'F' THEN 16 ELSE 0 END AS flag,
         CAST(round(l_tax * 100) AS INTEGER) = 8 AS has_sa,
         (['32M', '10M2I20M', '12M3D20M', '4S28M', '16M5N16M', '20M12X', '8=24M'])[l_linenumber % 7 + 1] AS cigar,
         translate(md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey)), '0123456789abcdef', 'ACGTACGTACGTACGN') AS seq,
         md5('q' || concat_ws('-', l_orderkey, l_linenumber, l_partkey)) AS qhex
  FROM lineitem
), elements(cigar, op, len, read_pos, ref_offset) AS (
  VALUES ('32M', 'M', 32, 1, 0), ('10M2I20M', 'M', 10, 1, 0), ('10M2I20M', 'I', 2, 11, 10), ('10M2I20M', 'M', 20, 13, 10),
         ('12M3D20M', 'M', 12, 1, 0), ('12M3D20M', 'D', 3, 13, 12), ('12M3D20M', 'M', 20, 13, 15), ('4S28M', 'S', 4, 1, 0),
         ('4S28M', 'M', 28, 5, 0), ('16M5N16M', 'M', 16, 1, 0), ('16M5N16M', 'N', 5, 17, 16), ('16M5N16M', 'M', 16, 17, 21),
         ('20M12X', 'M', 20, 1, 0), ('20M12X', 'X', 12, 21, 20), ('8=24M', '=', 8, 1, 0), ('8=24M', 'M', 24, 9, 8)
), good AS (
  SELECT * FROM reads WHERE flag & 1284 = 0 AND mapq >= 30 AND NOT has_sa
), spans(cigar, span) AS (
  VALUES ('32M', 32), ('10M2I20M', 30), ('12M3D20M', 35), ('4S28M', 28), ('16M5N16M', 37), ('20M12X', 32), ('8=24M', 32)
)"""

REFERENCE = """
ref AS (
  SELECT r AS ref_id, CAST(p AS INTEGER) AS position,
         translate(substr(md5(concat_ws('-', 'ref', r, p)), 1, 1), '0123456789abcdef', 'ACGTACGTACGTACGT') AS base
  FROM range(4) a(r), range(1, 545) b(p)
)"""

CODONS = (
    READS
    + """, windows AS (
  SELECT sample_id, ref_id, flag, pos + ref_offset + i AS position, substr(seq, CAST(read_pos + i AS BIGINT), 3) AS codon,
         (instr('0123456789abcdef', substr(qhex, CAST(read_pos + i AS BIGINT), 1)) - 1) * 2 + 10 AS q1,
         (instr('0123456789abcdef', substr(qhex, CAST(read_pos + i + 1 AS BIGINT), 1)) - 1) * 2 + 10 AS q2,
         (instr('0123456789abcdef', substr(qhex, CAST(read_pos + i + 2 AS BIGINT), 1)) - 1) * 2 + 10 AS q3
  FROM (SELECT *, unnest(range(0, len - 2)) AS i FROM good JOIN elements USING (cigar) WHERE op IN ('M', '=', 'X'))
), observed AS (SELECT * FROM windows WHERE regexp_full_match(codon, '[ACGT]{3}')
), masked AS (
  SELECT sample_id, ref_id, flag, position, codon, CASE WHEN q1 >= 30 THEN q1 ELSE 0 END AS q1, CASE WHEN q2 >= 30 THEN q2 ELSE 0 END AS q2,
         CASE WHEN q3 >= 30 THEN q3 ELSE 0 END AS q3
  FROM observed WHERE q1 >= 30 OR q2 >= 30 OR q3 >= 30
)"""
)


def _swarm(name: str, where: str) -> str:
    return f"""{name} AS (
  SELECT sample_id, ref_id, position, codon, count(*) / CAST(sum(count(*)) OVER (PARTITION BY sample_id, ref_id, position) AS DOUBLE) AS freq
  FROM masked WHERE q1 > 0 AND q2 > 0 AND q3 > 0 AND {where} GROUP BY sample_id, ref_id, position, codon
)"""


SWARM = CODONS + ", " + _swarm("swarm", "true")
STRANDS = SWARM + ", " + _swarm("forward", "flag & 16 = 0") + ", " + _swarm("reverse", "flag & 16 = 16")
CODE = """
code AS (
  SELECT substr('ACGT', CAST(i // 16 + 1 AS BIGINT), 1) || substr('ACGT', CAST(i // 4 % 4 + 1 AS BIGINT), 1) || substr('ACGT', CAST(i % 4 + 1 AS BIGINT), 1) AS codon,
         substr('KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVV*Y*YSSSS*CWCLFLF', CAST(i + 1 AS BIGINT), 1) AS aa
  FROM range(64) t(i)
)"""
REF_CODONS = """
ref_codons AS (
  SELECT a.ref_id, a.position, a.base || b.base || c.base AS ref_codon
  FROM ref a JOIN ref b ON a.ref_id = b.ref_id AND b.position = a.position + 1 JOIN ref c ON a.ref_id = c.ref_id AND c.position = a.position + 2
)"""
FEATURES = """
features AS (
  SELECT concat_ws('-', p_brand, p_partkey) AS feature, CAST(p_partkey * 7 % 500 + 1 AS INTEGER) AS start_,
         CAST(p_partkey * 7 % 500 + 3 * p_size AS INTEGER) AS end_, p_partkey AS row_no FROM part
)"""
SERIES = """
series AS (
  SELECT user_id, event_type, epoch_us(ts) / CAST(1e6 AS DOUBLE) AS t, avg(value) AS v FROM events GROUP BY ALL
), segments AS (
  SELECT *, lead(t) OVER w AS t2, lead(v) OVER w AS v2 FROM series WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t)
)"""
CURVE = (
    SERIES
    + """, times AS (
  SELECT DISTINCT user_id, t FROM series WHERE event_type IN ('click', 'view')
), valued AS (
  SELECT k.user_id, k.t, x.event_type, CASE WHEN x.t = k.t THEN x.v ELSE x.v + (x.v2 - x.v) * (k.t - x.t) / (x.t2 - x.t) END AS value
  FROM times k JOIN segments x ON x.user_id = k.user_id AND x.event_type IN ('click', 'view') AND k.t >= x.t AND (k.t < x.t2 OR k.t = x.t)
), gaps AS (
  SELECT user_id, t, max(value) FILTER (WHERE event_type = 'click') - max(value) FILTER (WHERE event_type = 'view') AS p FROM valued GROUP BY ALL
), led AS (
  SELECT user_id, CAST(row_number() OVER w - 1 AS INTEGER) AS seg, t AS t_start, lead(t) OVER w AS t_end, p, lead(p) OVER w AS p2
  FROM gaps WHERE p IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY t)
), curve AS (
  SELECT user_id, seg, t_start, t_end, p, (p2 - p) / (t_end - t_start) AS q FROM led WHERE t_end IS NOT NULL
)"""
)
POINTS = """
points AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: round(CAST(v AS DOUBLE), 4)) AS x, round(CAST(embedding[1] AS DOUBLE), 4) AS fitness FROM embeddings
), parts AS (
  SELECT label, i, avg(x[i]) AS m FROM points, range(1, 65) r(i) GROUP BY ALL
), centres AS (
  SELECT label AS centre, list(m ORDER BY i) AS cx FROM parts GROUP BY label
), fits AS (
  SELECT label AS centre, avg(fitness) AS centre_fitness FROM points GROUP BY label
)"""
DISTANCES = (
    POINTS
    + """, distances AS (
  SELECT vec_id, label, fitness, c.centre, centre_fitness, list_sum(list_transform(list_zip(x, cx), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2
  FROM points, centres c JOIN fits f USING (centre)
)"""
)
GRAPH = (
    POINTS
    + """, pairs AS (
  SELECT a.centre AS i, b.centre AS j, sqrt(list_sum(list_transform(list_zip(a.cx, b.cx), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d
  FROM centres a JOIN centres b ON a.centre <> b.centre
), ranked AS (SELECT i, j, d FROM (SELECT *, rank() OVER (PARTITION BY i ORDER BY d) AS r FROM pairs) WHERE r <= 3
), graph AS (SELECT i, j, min(d) AS d FROM (SELECT * FROM ranked UNION ALL SELECT j, i, d FROM ranked) GROUP BY ALL)"""
)

TO_ALL = """
met AS (
  SELECT a.vec_id, b.vec_id AS nearest, b.fitness AS predicted, round(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 8) AS d2
  FROM points a JOIN points b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)"""

PATHS = (
    SERIES
    + """, paths AS (SELECT user_id, event_type, t, v AS v1, abs(v - 50) / 10 AS v2 FROM series
), legs AS (
  SELECT *, lead(t) OVER w AS tn, lead(v1) OVER w AS n1, lead(v2) OVER w AS n2 FROM paths WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t)
), times AS (SELECT DISTINCT user_id, t FROM paths WHERE event_type IN ('click', 'view')
), valued AS (
  SELECT k.user_id, k.t, x.event_type, CASE WHEN x.t = k.t THEN x.v1 ELSE x.v1 + (x.n1 - x.v1) * (k.t - x.t) / (x.tn - x.t) END AS v1,
         CASE WHEN x.t = k.t THEN x.v2 ELSE x.v2 + (x.n2 - x.v2) * (k.t - x.t) / (x.tn - x.t) END AS v2
  FROM times k JOIN legs x ON x.user_id = k.user_id AND x.event_type IN ('click', 'view') AND k.t >= x.t AND (k.t < x.tn OR k.t = x.t)
), gaps AS (
  SELECT user_id, t, max(v1) FILTER (WHERE event_type = 'click') - max(v1) FILTER (WHERE event_type = 'view') AS p1,
         max(v2) FILTER (WHERE event_type = 'click') - max(v2) FILTER (WHERE event_type = 'view') AS p2 FROM valued GROUP BY ALL
), led AS (
  SELECT user_id, CAST(row_number() OVER w - 1 AS INTEGER) AS seg, t AS t_start, lead(t) OVER w AS t_end, p1, p2, lead(p1) OVER w AS e1, lead(p2) OVER w AS e2
  FROM gaps WHERE p1 IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY t)
), sloped AS (SELECT *, (e1 - p1) / (t_end - t_start) AS q1, (e2 - p2) / (t_end - t_start) AS q2 FROM led WHERE t_end IS NOT NULL
), curve AS (SELECT user_id, seg, t_start, t_end, p1 * p1 + p2 * p2 AS c, 2 * (p1 * q1 + p2 * q2) AS b, q1 * q1 + q2 * q2 AS a FROM sloped)"""
)
ALL_PAIRS = """
met AS (
  SELECT a.vec_id, b.vec_id AS nearest, a.fitness AS truth, b.fitness AS fitness, round(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 8) AS d2
  FROM points a JOIN points b ON a.vec_id <> b.vec_id
)"""


def _splits(n: int) -> str:
    """Pairs of a tested and a trained point by split and width, with the places of the distances."""
    return f"""widths AS (SELECT CAST(unnest([0.1, 0.2, 0.4, 0.8]) AS DOUBLE) AS sigma
), dealt AS (SELECT vec_id, s AS split, substr(md5('split-' || s || '-' || vec_id), 1, 8) < '19999999' AS test FROM points, range({n}) r(s)
), pairs AS (
  SELECT m.*, u.split, row_number() OVER (PARTITION BY u.split, m.vec_id ORDER BY d2, nearest) AS place
  FROM met m JOIN dealt u ON u.vec_id = m.vec_id AND u.test JOIN dealt k ON k.vec_id = m.nearest AND k.split = u.split AND NOT k.test
), scaled AS (
  SELECT *, min(d2) OVER (PARTITION BY split, vec_id) AS low, min(CASE WHEN place > 1 THEN d2 END) OVER (PARTITION BY split, vec_id) AS low2 FROM pairs
)"""


ORACLE_SQL = {
    "cigar_walk": f"""WITH {READS}
SELECT ref_id, cigar, op, read_pos, ref_offset, count(*) AS n, CAST(sum(pos + ref_offset) AS BIGINT) AS sum_ref_pos
FROM reads JOIN elements USING (cigar) GROUP BY ALL""",
    "aligned_length": f"""WITH {READS}
SELECT ref_id, span, count(*) AS n, min(pos) AS first_pos, max(pos + span - 1) AS last_end FROM reads JOIN spans USING (cigar) GROUP BY ALL""",
    "region_scan": f"""WITH {READS}
SELECT pos, cigar, count(*) AS n, CAST(sum(mapq) AS BIGINT) AS sum_mapq FROM reads JOIN spans USING (cigar)
WHERE ref_id = 1 AND pos <= 260 AND pos + span - 1 >= 200 GROUP BY ALL""",
    "bin_assign": f"""WITH {READS}, b AS (
  SELECT CAST(pos AS BIGINT) * 16381 - 1 AS s, CAST(pos AS BIGINT) * 16381 + span * 97 - 2 AS e FROM reads JOIN spans USING (cigar)
)
SELECT CASE WHEN s >> 14 = e >> 14 THEN (s >> 14) + 4681 WHEN s >> 17 = e >> 17 THEN (s >> 17) + 585 WHEN s >> 20 = e >> 20 THEN (s >> 20) + 73
            WHEN s >> 23 = e >> 23 THEN (s >> 23) + 9 WHEN s >> 26 = e >> 26 THEN (s >> 26) + 1 ELSE 0 END AS bin, count(*) AS n,
       CAST(max(6 + (e >> 14) - (s >> 14) + (e >> 17) - (s >> 17) + (e >> 20) - (s >> 20) + (e >> 23) - (s >> 23) + (e >> 26) - (s >> 26)) AS INTEGER) AS most_bins
FROM b GROUP BY 1""",
    "flag_summary": f"""WITH {READS}
SELECT ref_id, count(*) FILTER (WHERE ok) AS "both", count(*) FILTER (WHERE ok AND flag & 16 = 0) AS forward,
       count(*) FILTER (WHERE ok AND flag & 16 = 16) AS reverse, count(*) FILTER (WHERE flag & 256 <> 0) AS secondary
FROM (SELECT *, flag & 1284 = 0 AND mapq >= 30 AND NOT has_sa AS ok FROM reads) GROUP BY ref_id""",
    "codon_counts": f"WITH {CODONS} SELECT ref_id, position, codon, q1, q2, q3, count(*) AS n FROM observed GROUP BY ALL",
    "codon_counts_masked": f"WITH {CODONS} SELECT ref_id, position, codon, q1, q2, q3, count(*) AS n FROM masked GROUP BY ALL",
    "codon_counts_unambiguous": f"""WITH {CODONS}, c AS (SELECT ref_id, position, codon, q1, q2, q3, count(*) AS n FROM masked GROUP BY ALL),
complete AS (SELECT DISTINCT ref_id, position, codon FROM c WHERE q1 > 0 AND q2 > 0 AND q3 > 0)
SELECT * FROM c WHERE EXISTS (
  SELECT 1 FROM complete k WHERE k.ref_id = c.ref_id AND k.position = c.position AND (c.q1 = 0 OR k.codon[1] = c.codon[1])
  AND (c.q2 = 0 OR k.codon[2] = c.codon[2]) AND (c.q3 = 0 OR k.codon[3] = c.codon[3]))""",
    "nuc_counts": f"""WITH {READS}, w AS (
  SELECT ref_id, pos + ref_offset + i AS position, substr(seq, CAST(read_pos + i AS BIGINT), 1) AS nuc,
         (instr('0123456789abcdef', substr(qhex, CAST(read_pos + i AS BIGINT), 1)) - 1) * 2 + 10 AS q
  FROM (SELECT *, unnest(range(0, len)) AS i FROM good JOIN elements USING (cigar) WHERE op IN ('M', '=', 'X'))
)
SELECT ref_id, position, nuc, q, count(*) AS n FROM w WHERE nuc IN ('A', 'C', 'G', 'T') AND q >= 30 GROUP BY ALL""",
    "read_coverage": f"""WITH {READS}, {REFERENCE}, over_ AS (
  SELECT ref_id, unnest(range(pos + ref_offset, pos + ref_offset + len)) AS position FROM good JOIN elements USING (cigar) WHERE op IN ('M', '=', 'X')
), n AS (SELECT ref_id, position, count(*) AS coverage FROM over_ GROUP BY ALL)
SELECT ref_id, position, coalesce(coverage, 0) AS coverage FROM ref LEFT JOIN n USING (ref_id, position)""",
    "coverage_matrix": f"""WITH {READS}, {REFERENCE}, over_ AS (
  SELECT sample_id, unnest(range(pos + ref_offset, pos + ref_offset + len)) AS position FROM good JOIN elements USING (cigar) WHERE op IN ('M', '=', 'X')
), n AS (SELECT sample_id, position, count(*) AS coverage FROM over_ GROUP BY ALL)
SELECT sample_id, ref_id, position, coalesce(coverage, 0) AS coverage
FROM range(20) s(sample_id) JOIN ref ON ref_id = sample_id % 4 LEFT JOIN n USING (sample_id, position)""",
    "mean_coverage_filter": f"""WITH {READS}, n AS (
  SELECT sample_id, sum(len) AS bases FROM good JOIN elements USING (cigar) WHERE op IN ('M', '=', 'X') GROUP BY sample_id
)
SELECT sample_id, round(CAST(bases AS DOUBLE) / 544, 6) AS mean_coverage FROM n WHERE CAST(bases AS DOUBLE) / 544 >= 20""",
    "consensus_counts": f"""WITH {READS}, c AS (SELECT ref_id, pos + ref_offset AS p, seq, op, len, read_pos FROM good JOIN elements USING (cigar)),
b AS (SELECT *, unnest(range(0, len)) AS i FROM c WHERE op IN ('M', '=', 'X')),
e AS (
  SELECT ref_id, p + i AS position, 'base' AS kind, substr(seq, CAST(read_pos + i AS BIGINT), 1) AS value FROM b WHERE substr(seq, CAST(read_pos + i AS BIGINT), 1) <> 'N'
  UNION ALL SELECT ref_id, p + i, 'next', '' FROM b WHERE i < len - 1
  UNION ALL SELECT ref_id, p - 1, 'ins', substr(seq, read_pos, len) FROM c WHERE op = 'I'
  UNION ALL SELECT ref_id, p - 1, 'del', CAST(len AS VARCHAR) FROM c WHERE op = 'D'
)
SELECT ref_id, position, kind, value, count(*) AS n FROM e WHERE position >= 1 GROUP BY ALL""",
    "consensus_bases": f"""WITH {READS}, {REFERENCE}, b AS (
  SELECT ref_id, pos + ref_offset + i AS position, substr(seq, CAST(read_pos + i AS BIGINT), 1) AS nuc
  FROM (SELECT *, unnest(range(0, len)) AS i FROM good JOIN elements USING (cigar) WHERE op IN ('M', '=', 'X'))
), n AS (SELECT ref_id, position, nuc, count(*) AS n FROM b WHERE nuc <> 'N' GROUP BY ALL),
best AS (SELECT ref_id, position, nuc FROM (SELECT *, row_number() OVER (PARTITION BY ref_id, position ORDER BY n DESC, nuc) AS r FROM n) WHERE r = 1)
SELECT ref_id, position, coalesce(nuc, base) AS base FROM ref LEFT JOIN best USING (ref_id, position)""",
    "codon_freq_naive": f"""WITH {CODONS}
SELECT ref_id, position, codon, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY ref_id, position) AS DOUBLE), 6) AS freq
FROM masked WHERE q1 > 0 AND q2 > 0 AND q3 > 0 GROUP BY ref_id, position, codon""",
    "swarm_select": f"""WITH {SWARM}
SELECT sample_id, ref_id, position, codon, round(freq, 6) AS freq FROM swarm
WHERE position BETWEEN 100 AND 160 AND codon IN ('AAA', 'CCC', 'ACG') AND sample_id <> 3""",
    "swarm_concat": f"""WITH {STRANDS}, u AS (SELECT sample_id, freq, 1 AS f, NULL AS r FROM forward UNION ALL SELECT sample_id, freq, NULL, 1 FROM reverse)
SELECT sample_id, count(f) AS forward_cells, count(r) AS reverse_cells, round(sum(freq), 4) AS mass FROM u GROUP BY sample_id""",
    "swarm_annotate": f"""WITH {SWARM}, {REFERENCE}, {REF_CODONS}, {CODE}
SELECT sample_id, coalesce(aa, '?') AS amino_acid, count(*) AS cells, count(*) FILTER (WHERE codon = ref_codon) AS as_reference, round(sum(freq), 4) AS mass
FROM swarm LEFT JOIN ref_codons USING (ref_id, position) LEFT JOIN code USING (codon) GROUP BY 1, 2""",
    "swarm_consensus": f"""WITH {SWARM}
SELECT sample_id, ref_id, position, codon AS consensus, round(freq, 6) AS freq
FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, ref_id, position ORDER BY freq DESC, codon) AS r FROM swarm) WHERE r = 1""",
    "consensus_onehot": f"""WITH {SWARM}, h AS (SELECT *, max(freq) OVER (PARTITION BY sample_id, ref_id, position) AS top FROM swarm)
SELECT ref_id, position, count(*) FILTER (WHERE freq = top AND top >= 0.25) AS hot, count(*) AS cells FROM h GROUP BY ALL""",
    "center": f"""WITH {SWARM}
SELECT sample_id, ref_id, position, codon, round(freq - sum(freq) OVER (PARTITION BY ref_id, position, codon) / 20, 6) AS centred FROM swarm""",
    "variance_filter": f"""WITH {SWARM}, s AS (
  SELECT ref_id, position, codon, sum(freq) / 20 AS mean, sqrt(greatest((sum(freq * freq) - sum(freq) * sum(freq) / 20) / 19, CAST(0 AS DOUBLE))) AS sd FROM swarm GROUP BY ALL
)
SELECT ref_id, position, codon, round(mean, 6) AS mean, round(sd, 6) AS sd FROM s WHERE sd >= 0.5 * (SELECT max(sd) FROM s)""",
    "lod": f"""WITH RECURSIVE {STRANDS}, calls AS (
  SELECT sample_id, ref_id, position, codon AS consensus, sample_id % 2 AS run
  FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, ref_id, position ORDER BY freq DESC, codon) AS r FROM swarm) WHERE r = 1
), cells AS (
  SELECT sample_id, ref_id, position, codon, coalesce(a.freq, CAST(0 AS DOUBLE)) AS f, coalesce(b.freq, CAST(0 AS DOUBLE)) AS r
  FROM forward a FULL JOIN reverse b USING (sample_id, ref_id, position, codon)
), sizes AS (SELECT run, ref_id, position, consensus, count(*) AS n FROM calls GROUP BY ALL
), pairs AS (
  SELECT run, ref_id, position, consensus, codon, list({{'f': f, 'r': r}} ORDER BY sample_id) AS p FROM cells JOIN calls USING (sample_id, ref_id, position) GROUP BY ALL
), grouped AS (SELECT row_number() OVER () AS g, * FROM pairs JOIN sizes USING (run, ref_id, position, consensus)
), halved(g, ref_id, position, codon, p, n, lo, hi, step) AS (
  SELECT g, ref_id, position, codon, p, n, CAST(-6 AS DOUBLE), CAST(1 AS DOUBLE), 0 FROM grouped
  UNION ALL
  SELECT g, ref_id, position, codon, p, n, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END, step + 1
  FROM (SELECT *, sqrt(list_sum(list_transform(p, lambda z: power(log2(z.f + power(CAST(10 AS DOUBLE), mid)) - log2(z.r + power(CAST(10 AS DOUBLE), mid)), 2))) / n) <= log2(CAST(1.5 AS DOUBLE)) AS ok
        FROM (SELECT *, (lo + hi) / 2 AS mid FROM halved WHERE step < 13))
), ends AS (
  SELECT ref_id, position, codon, CASE WHEN sqrt(list_sum(list_transform(p, lambda z: power(log2(z.f + power(CAST(10 AS DOUBLE), -6)) - log2(z.r + power(CAST(10 AS DOUBLE), -6)), 2))) / n) <= log2(CAST(1.5 AS DOUBLE))
         THEN power(CAST(10 AS DOUBLE), -6) ELSE power(CAST(10 AS DOUBLE), (lo + hi) / 2) END AS alpha FROM halved WHERE step = 13
)
SELECT ref_id, position, codon, round(max(alpha), 6) AS lod FROM ends GROUP BY ALL""",
    "log_transform": f"""WITH {SWARM}
SELECT sample_id, ref_id, position, codon, round(log2(freq + greatest(min(freq) OVER (PARTITION BY ref_id, position, codon) / 10, CAST(0.001 AS DOUBLE))), 6) AS value FROM swarm""",
    "feature_positions": f"""WITH {FEATURES}, s AS (SELECT feature, start_, unnest(range(start_, end_ + 1, 3)) AS position FROM features WHERE end_ >= start_)
SELECT feature, CAST(position AS INTEGER) AS position, CAST((position - start_) // 3 + 1 AS INTEGER) AS codon_no FROM s""",
    "feature_at": f"""WITH {FEATURES}, m AS (
  SELECT p AS position, feature, start_, row_number() OVER (PARTITION BY p ORDER BY end_ - start_, row_no) AS r
  FROM range(1, 545) t(p) JOIN features ON p BETWEEN start_ AND end_
)
SELECT CAST(p AS INTEGER) AS position, coalesce(feature, '') AS feature, start_ AS feature_start FROM range(1, 545) t(p) LEFT JOIN m ON m.position = p AND r = 1""",
    "variant_labels": f"""WITH {CODONS}, {REFERENCE}, {REF_CODONS}, {CODE}, {FEATURES}, m AS (
  SELECT p AS position, feature, start_, row_number() OVER (PARTITION BY p ORDER BY end_ - start_, row_no) AS r
  FROM range(1, 545) t(p) JOIN features ON p BETWEEN start_ AND end_
), v AS (SELECT DISTINCT ref_id, position, codon FROM masked)
SELECT v.ref_id, v.position, v.codon, feature || '-' || coalesce(a.aa, '?') || CAST((v.position - start_) // 3 + 1 AS VARCHAR) || coalesce(b.aa, '?') AS label
FROM v JOIN m ON m.position = v.position AND r = 1 AND (v.position - start_) % 3 = 0 JOIN ref_codons k ON k.ref_id = v.ref_id AND k.position = v.position
LEFT JOIN code a ON a.codon = k.ref_codon LEFT JOIN code b ON b.codon = v.codon""",
    "codon_translate": f"""WITH {READS}, {CODE}, k AS (SELECT ref_id, substr(seq, CAST(i AS BIGINT), 3) AS codon FROM reads, range(1, 31) t(i))
SELECT ref_id, coalesce(aa, '?') AS amino_acid, count(*) AS n FROM k LEFT JOIN code USING (codon) GROUP BY 1, 2""",
    "kmer_docs": """WITH k AS (
  SELECT lang, list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3)) AS g FROM documents WHERE length(text) >= 3
)
SELECT lang, kmer, count(*) AS n FROM (SELECT lang, unnest(g) AS kmer FROM k) GROUP BY ALL""",
    "lev_names": """SELECT p_partkey, CAST(levenshtein(p_type, p_brand) AS INTEGER) AS edits, CAST(hamming(p_name, reverse(p_name)) AS INTEGER) AS mismatches FROM part""",
    "ts_at": f"""WITH {SERIES}, k AS (
  SELECT *, unnest(range(CAST(ceil(t / 86400) AS BIGINT), CAST(CASE WHEN t2 IS NULL THEN floor(t / 86400) ELSE ceil(t2 / 86400) - 1 END AS BIGINT) + 1)) AS k FROM segments
)
SELECT user_id, event_type, k * CAST(86400 AS DOUBLE) AS t, round(CASE WHEN k * 86400 = t THEN v ELSE v + (v2 - v) * (k * 86400 - t) / (t2 - t) END, 4) AS v FROM k""",
    "ts_mean": f"""WITH {SERIES}
SELECT user_id, event_type, round(CASE WHEN count(t2) > 0 THEN sum((t2 - t) * (v + v2) / 2) / sum(t2 - t) ELSE avg(v) END, 4) AS mean FROM segments GROUP BY ALL""",
    "ts_median_filter": f"""WITH {SERIES}, a AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id, event_type) AS n,
         list(v) OVER (PARTITION BY user_id, event_type ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS vs
  FROM series WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t)
)
SELECT user_id, event_type, t, round(list_sort(list_transform(range(-2, 3), lambda d: vs[least(greatest(i + d, 1), n)]))[3], 6) AS v FROM a""",
    "distance_curve": f"WITH {CURVE} SELECT user_id, seg, t_start, t_end, round(p * p, 2) AS c FROM curve",
    "bifurcation": f"""WITH {CURVE}, roots AS (
  SELECT user_id, t_start + s AS t FROM (
    SELECT *, CASE WHEN q = 0 THEN CASE WHEN p = 10 OR p = -10 THEN NULL END ELSE (10 - p) / q END AS s FROM curve WHERE abs(q * q) >= 1e-16
    UNION ALL SELECT *, (-10 - p) / q AS s FROM curve WHERE abs(q * q) >= 1e-16)
  WHERE s > 0 AND s <= t_end - t_start
), firsts AS (SELECT user_id, t_start, abs(p) AS d FROM curve WHERE seg = 0)
SELECT user_id, round(CASE WHEN any_value(d) >= 10 THEN any_value(t_start) ELSE min(t) END, 0) AS t FROM firsts LEFT JOIN roots USING (user_id) GROUP BY user_id""",
    "curve_mean": f"""WITH {CURVE}, areas AS (
  SELECT user_id, t_end - t_start AS n, p, p + q * (t_end - t_start) AS e, q FROM curve
)
SELECT user_id, round(sum(CASE WHEN p * e >= 0 THEN (abs(p) + abs(e)) / 2 * n ELSE (p * p + e * e) / (abs(p) + abs(e)) / 2 * n END) / sum(n), 2) AS mean FROM areas GROUP BY user_id""",
    "sq_distances": f"WITH {DISTANCES} SELECT vec_id, centre, round(d2, 6) AS d2 FROM distances",
    "nn_predict": f"""WITH {DISTANCES}
SELECT vec_id, centre, round(centre_fitness, 6) AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, centre) AS r FROM distances) WHERE r = 1""",
    "gks_predict": f"""WITH {DISTANCES}, w AS (SELECT vec_id, centre_fitness, exp((min(d2) OVER (PARTITION BY vec_id) - d2) / (2 * CAST(0.2 AS DOUBLE) * 0.2)) AS w FROM distances)
SELECT vec_id, round(sum(w * centre_fitness) / sum(w), 6) AS predicted FROM w GROUP BY vec_id""",
    "kernel_width": f"""WITH {DISTANCES}, w AS (
  SELECT vec_id, sigma, fitness, centre_fitness, exp((min(d2) OVER (PARTITION BY vec_id) - d2) / (2 * sigma * sigma)) AS w
  FROM distances, (SELECT CAST(unnest([0.05, 0.1, 0.2, 0.4, 0.8]) AS DOUBLE) AS sigma)
), e AS (SELECT sigma, vec_id, power(sum(w * centre_fitness) / sum(w) - any_value(fitness), 2) AS e FROM w GROUP BY sigma, vec_id)
SELECT sigma, round(avg(e), 5) AS mse FROM e GROUP BY sigma""",
    "group_predict": f"WITH {POINTS} SELECT vec_id, label, round(avg(fitness) OVER (PARTITION BY label), 6) AS predicted FROM points",
    "loo_group_predict": f"""WITH {POINTS}
SELECT vec_id, label, round(CASE WHEN count(*) OVER w > 1 THEN (sum(fitness) OVER w - fitness) / (count(*) OVER w - 1) END, 6) AS predicted FROM points WINDOW w AS (PARTITION BY label)""",
    "variance_unexplained": f"""WITH {POINTS}, l AS (
  SELECT fitness AS truth, CASE WHEN count(*) OVER w > 1 THEN (sum(fitness) OVER w - fitness) / (count(*) OVER w - 1) END AS predicted FROM points WINDOW w AS (PARTITION BY label)
)
SELECT round(sum(power(predicted - truth, 2)) / (var_pop(truth) * count(*)), 6) AS unexplained, count(*) AS n FROM l WHERE predicted IS NOT NULL AND truth IS NOT NULL""",
    "knn_graph": f"WITH {GRAPH} SELECT i, j, round(d, 6) AS d FROM graph",
    "shortest_paths": f"""WITH {GRAPH}, two AS (
  SELECT i, j, min(d) AS d FROM (SELECT * FROM graph UNION ALL SELECT a.i, b.j, a.d + b.d FROM graph a JOIN graph b ON a.j = b.i AND a.i <> b.j) GROUP BY ALL
), four AS (
  SELECT i, j, min(d) AS d FROM (SELECT * FROM two UNION ALL SELECT a.i, b.j, a.d + b.d FROM two a JOIN two b ON a.j = b.i AND a.i <> b.j) GROUP BY ALL
), eight AS (
  SELECT i, j, min(d) AS d FROM (SELECT * FROM four UNION ALL SELECT a.i, b.j, a.d + b.d FROM four a JOIN four b ON a.j = b.i AND a.i <> b.j) GROUP BY ALL
), sixteen AS (
  SELECT i, j, min(d) AS d FROM (SELECT * FROM eight UNION ALL SELECT a.i, b.j, a.d + b.d FROM eight a JOIN eight b ON a.j = b.i AND a.i <> b.j) GROUP BY ALL
)
SELECT i, j, round(d, 6) AS d FROM sixteen""",
    "nn_samples": f"""WITH {POINTS}, {TO_ALL}
SELECT vec_id, nearest, round(d2, 6) AS d2, round(predicted, 6) AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, nearest) AS r FROM met) WHERE r = 1""",
    "gks_samples": f"""WITH {POINTS}, {TO_ALL}, w AS (SELECT vec_id, predicted, exp((min(d2) OVER (PARTITION BY vec_id) - d2) / (2 * CAST(0.2 AS DOUBLE) * 0.2)) AS w FROM met)
SELECT vec_id, round(sum(w * predicted) / sum(w), 6) AS predicted FROM w GROUP BY vec_id""",
    "metadata_filter": """SELECT c_name AS sample_id, c_mktsegment AS run, c_nationkey AS reference, c_acctbal AS dose FROM customer
WHERE c_nationkey IN (1, 3, 5, 7) AND c_acctbal > 0 AND (c_name LIKE '%1' OR c_name LIKE '%7')""",
    "sample_lookup": """WITH f AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
SELECT c_name AS sample_id, o_orderkey, o_totalprice FROM customer LEFT JOIN f ON o_custkey = c_custkey AND r = 1""",
    "fitness_join": """WITH fit AS (
  SELECT o_orderkey AS fit_row, CASE WHEN o_orderkey % 4 = 0 THEN 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS sample_id,
         CAST(o_custkey % 25 AS INTEGER) AS reference,
         list_avg(list_filter([CASE WHEN o_orderkey % 2 <> 0 THEN o_totalprice / 2 END, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice / 3 END,
                               CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 5 END], lambda x: x IS NOT NULL)) AS fitness
  FROM orders
), known AS (SELECT * FROM fit WHERE fitness IS NOT NULL
), firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY fit_row) AS r FROM known WHERE sample_id IS NOT NULL) WHERE r = 1
), direct AS (SELECT c_name AS sample_id, c_nationkey AS reference, c_custkey AS "row", f.fit_row, f.fitness FROM customer LEFT JOIN firsts f ON f.sample_id = c_name
), unused AS (SELECT reference, fitness, row_number() OVER (PARTITION BY reference ORDER BY fit_row) AS rn FROM known WHERE fit_row NOT IN (SELECT fit_row FROM direct WHERE fit_row IS NOT NULL)
), rest AS (SELECT sample_id, reference, "row", row_number() OVER (PARTITION BY reference ORDER BY "row") AS rn FROM direct WHERE fit_row IS NULL)
SELECT sample_id, reference, "row", round(fitness, 4) AS fitness FROM direct WHERE fit_row IS NOT NULL
UNION ALL SELECT sample_id, reference, "row", round(fitness, 4) FROM rest LEFT JOIN unused USING (reference, rn)""",
    "lin_reg_groups": """WITH l AS (
  SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, min(l_quantity) AS x1, max(l_quantity) AS x2
  FROM lineitem GROUP BY l_returnflag
)
SELECT l_returnflag, round(slope, 4) AS slope, round(intercept, 4) AS intercept, x1, x2, round(intercept + slope * x1, 4) AS y1, round(intercept + slope * x2, 4) AS y2 FROM l""",
    "ts_asked": f"""WITH {SERIES}, clicks AS (SELECT * FROM segments WHERE event_type = 'click'), asked AS (SELECT user_id, t FROM series WHERE event_type = 'view'
), firsts AS (SELECT user_id, arg_min(v, t) AS first_v FROM clicks GROUP BY user_id)
SELECT a.user_id, a.t, round(CASE WHEN c.t IS NULL THEN first_v WHEN c.t = a.t OR c.t2 IS NULL THEN c.v ELSE c.v + (c.v2 - c.v) * ((a.t - c.t) / (c.t2 - c.t)) END, 6) AS value
FROM asked a ASOF LEFT JOIN clicks c ON a.user_id = c.user_id AND a.t >= c.t LEFT JOIN firsts f ON f.user_id = a.user_id""",
    "path_curve": f"WITH {PATHS} SELECT user_id, seg, t_start, t_end, round(c, 6) AS c, round(b, 6) AS b, round(a, 6) AS a FROM curve",
    "curve_at": f"""WITH {PATHS}, asked AS (SELECT user_id, t FROM series WHERE event_type = 'purchase')
SELECT a.user_id, a.t, round(CASE WHEN a.t <= t_end THEN sqrt(greatest(c + (a.t - t_start) * (b + (a.t - t_start) * a), CAST(0 AS DOUBLE))) END, 6) AS distance
FROM asked a ASOF LEFT JOIN curve k ON a.user_id = k.user_id AND a.t >= k.t_start""".replace("(b + (a.t - t_start) * a)", "(b + (a.t - t_start) * k.a)"),
    "kernel_width_splits": f"""WITH {POINTS}, {ALL_PAIRS}, {_splits(8)}, predicted AS (
  SELECT split, sigma, vec_id, any_value(truth) AS truth, sum(exp((low - d2) / (2 * sigma * sigma)) * fitness) / sum(exp((low - d2) / (2 * sigma * sigma))) AS f
  FROM scaled, widths GROUP BY split, sigma, vec_id
), of_split AS (SELECT split, sigma, avg(power(f - truth, 2)) AS mse FROM predicted GROUP BY split, sigma
), errors AS (SELECT sigma, avg(mse) AS mse FROM of_split GROUP BY sigma)
SELECT sigma, round(mse, 6) AS mse, sigma = (SELECT arg_min(sigma, mse) FROM errors) AS best FROM errors""",
    "kernel_width_without_one": f"""WITH {POINTS}, {ALL_PAIRS}, {_splits(4)}, weighted AS (
  SELECT *, exp((low - d2) / (2 * sigma * sigma)) AS w, CASE WHEN place > 1 THEN exp((low2 - d2) / (2 * sigma * sigma)) ELSE 0 END AS w2 FROM scaled, widths
), summed AS (
  SELECT *, sum(w) OVER g AS ws, sum(w * fitness) OVER g AS wf, sum(w2) OVER g AS ws2, sum(w2 * fitness) OVER g AS wf2
  FROM weighted WINDOW g AS (PARTITION BY split, sigma, vec_id)
), trained AS (
  SELECT nearest AS vec_id, split, sigma, avg(power(CASE WHEN place = 1 THEN CASE WHEN ws2 > 0 THEN wf2 / ws2 END ELSE (wf - w * fitness) / (ws - w) END - truth, 2)) AS mse
  FROM summed GROUP BY nearest, split, sigma
), own AS (SELECT DISTINCT split, sigma, vec_id, power(wf / ws - truth, 2) AS e FROM summed
), tested AS (
  SELECT vec_id, split, sigma, (sum(e) OVER g - e) / (count(*) OVER g - 1) AS mse, count(*) OVER g AS n FROM own WINDOW g AS (PARTITION BY split, sigma)
), each AS (
  SELECT vec_id, sigma, avg(mse) AS mse FROM (SELECT vec_id, split, sigma, mse FROM trained UNION ALL SELECT vec_id, split, sigma, mse FROM tested WHERE n > 1) GROUP BY vec_id, sigma
)
SELECT vec_id, arg_min(sigma, mse) AS sigma, round(min(mse), 6) AS mse FROM each GROUP BY vec_id""",
    "loo_nn_predict": f"""WITH {POINTS}, {ALL_PAIRS}
SELECT vec_id, nearest, round(d2, 6) AS d2, round(fitness, 6) AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, nearest) AS r FROM met) WHERE r = 1""",
    "loo_gks_predict": f"""WITH {POINTS}, {ALL_PAIRS}, w AS (SELECT vec_id, fitness, exp((min(d2) OVER (PARTITION BY vec_id) - d2) / (2 * CAST(0.2 AS DOUBLE) * 0.2)) AS w FROM met)
SELECT vec_id, round(sum(w * fitness) / sum(w), 6) AS predicted FROM w GROUP BY vec_id""",
    "categorical_nn": """WITH x AS (
  SELECT p_partkey, p_retailprice AS fitness, [p_brand, p_type, string_split(p_name, ' ')[1], string_split(p_name, ' ')[2], CAST(p_size % 10 AS VARCHAR), CAST(CAST(floor(p_size / 10) AS BIGINT) AS VARCHAR)] AS x FROM part
), d AS (
  SELECT a.p_partkey, b.fitness, len(list_filter(list_zip(a.x, b.x), lambda z: z[1] IS DISTINCT FROM z[2])) AS d FROM x a JOIN x b ON a.p_partkey <> b.p_partkey
), near AS (SELECT *, min(d) OVER (PARTITION BY p_partkey) AS least FROM d)
SELECT p_partkey, CAST(least AS INTEGER) AS differing, count(*) AS ties, round(avg(fitness), 6) AS predicted FROM near WHERE d = least GROUP BY p_partkey, least""",
    "knn_samples": f"""WITH {POINTS}, {ALL_PAIRS}, near AS (
  SELECT vec_id AS i, nearest AS j, sqrt(d2) AS d, rank() OVER (PARTITION BY vec_id ORDER BY d2) AS r FROM met
), close AS (SELECT i, j, d FROM near WHERE r <= 5)
SELECT i, j, round(min(d), 6) AS d FROM (SELECT * FROM close UNION ALL SELECT j, i, d FROM close) GROUP BY i, j""",
    "landscape": f"""WITH {POINTS}, grid AS (SELECT a / CAST(25 AS DOUBLE) - 1 AS x, b / CAST(25 AS DOUBLE) - 1 AS y FROM range(50) s(a), range(50) t(b)
), d AS (
  SELECT g.x, g.y, p.fitness, power(g.x - p.x[2], 2) + power(g.y - p.x[3], 2) AS d2 FROM grid g, points p
), l AS (SELECT *, min(d2) OVER (PARTITION BY x, y) AS low FROM d
), s AS (
  SELECT x, y, any_value(low) AS low, sum(exp((low - d2) / (2 * CAST(0.1 AS DOUBLE) * 0.1)) * fitness) / sum(exp((low - d2) / (2 * CAST(0.1 AS DOUBLE) * 0.1))) AS z,
         sum(exp((low - d2) / (2 * power(CAST(0.05 AS DOUBLE) * 1.96, 2)))) AS near FROM l GROUP BY x, y
), a AS (SELECT x, y, z, (ln(near) - low / (2 * power(CAST(0.05 AS DOUBLE) * 1.96, 2))) / ln(10) AS alpha FROM s)
SELECT x, y, round(z, 6) AS z, round(alpha, 6) AS alpha, round(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), alpha + 1.5)), 6) AS cover FROM a""",
    "weighted_edit": """WITH RECURSIVE dp(p_partkey, a, b, i, r) AS (
  SELECT p_partkey, p_type, p_brand, 0, list_transform(range(0, length(p_brand) + 1), lambda j: CAST(10 * j AS DOUBLE)) FROM part
  UNION ALL
  SELECT p_partkey, a, b, i + 1, list_transform(range(1, length(b) + 2), lambda j: list_min(list_transform(range(1, j + 1), lambda k: c[k] + 10 * (j - k))))
  FROM (
    SELECT *, list_transform(range(1, length(b) + 2), lambda k: CASE WHEN k = 1 THEN CAST(10 * (i + 1) AS DOUBLE)
      ELSE least(r[k] + 10, r[k - 1] + CASE WHEN substr(b, k - 1, 1) = substr(a, i + 1, 1) THEN 0 ELSE 1 END) END) AS c
    FROM dp WHERE i < length(a)
  )
)
SELECT p_partkey, r[length(b) + 1] AS cost FROM dp WHERE i = length(a)""",
    "consensus_sequence": f"""WITH RECURSIVE {READS}, {REFERENCE}, c AS (SELECT ref_id, pos + ref_offset AS p, seq, op, len, read_pos FROM good JOIN elements USING (cigar)
), b AS (SELECT *, unnest(range(0, len)) AS i FROM c WHERE op IN ('M', '=', 'X')
), e AS (
  SELECT ref_id, p + i AS position, 'base' AS kind, substr(seq, CAST(read_pos + i AS BIGINT), 1) AS value FROM b WHERE substr(seq, CAST(read_pos + i AS BIGINT), 1) <> 'N'
  UNION ALL SELECT ref_id, p + i, 'next', '' FROM b WHERE i < len - 1
  UNION ALL SELECT ref_id, p - 1, 'ins', substr(seq, read_pos, len) FROM c WHERE op = 'I'
  UNION ALL SELECT ref_id, p - 1, 'del', CAST(len AS VARCHAR) FROM c WHERE op = 'D'
), n AS (SELECT ref_id, position, kind, value, count(*) AS n FROM e WHERE position >= 1 GROUP BY ALL
), best AS (
  SELECT ref_id, position, kind, value, n FROM (SELECT *, row_number() OVER (PARTITION BY ref_id, position, kind ORDER BY n DESC, CASE WHEN kind = 'base' THEN ascii(value) WHEN kind = 'ins' THEN length(value)
    WHEN kind = 'del' THEN CAST(value AS INTEGER) ELSE 0 END, translate(value, 'ACGTN', 'tgcan') DESC) AS r FROM n) WHERE r = 1
), sites AS (
  SELECT ref.ref_id, ref.position, coalesce(k.value, base) AS base, coalesce(i.n, 0) AS n_ins, i.value AS ins, coalesce(d.n, 0) AS n_del, CAST(d.value AS INTEGER) AS del, coalesce(x.n, 0) AS n_next
  FROM ref LEFT JOIN best k ON k.ref_id = ref.ref_id AND k.position = ref.position AND k.kind = 'base' LEFT JOIN best i ON i.ref_id = ref.ref_id AND i.position = ref.position AND i.kind = 'ins'
  LEFT JOIN best d ON d.ref_id = ref.ref_id AND d.position = ref.position AND d.kind = 'del' LEFT JOIN best x ON x.ref_id = ref.ref_id AND x.position = ref.position AND x.kind = 'next'
), fired AS (SELECT *, greatest(n_ins, n_del) >= greatest(n_next + 1, 1) AS fires FROM sites
), scan(ref_id, place, skip, sequence) AS (
  SELECT ref_id, 0, 0, '' FROM (SELECT DISTINCT ref_id FROM ref)
  UNION ALL
  SELECT s.ref_id, s.place + 1, CASE WHEN skip > 0 THEN skip - 1 WHEN fires AND n_ins <= n_del THEN del ELSE 0 END,
         CASE WHEN skip > 0 THEN sequence ELSE sequence || base || CASE WHEN fires AND n_ins > n_del THEN ins ELSE '' END END
  FROM scan s JOIN fired f ON f.ref_id = s.ref_id AND f.position = s.place + 1
)
SELECT ref_id, sequence FROM scan WHERE place = 544""",
    "read_errors": f"""WITH {READS}, b AS (SELECT *, unnest(range(1, 33)) AS i FROM reads
), e AS (SELECT sample_id, ref_id, least(power(10, -((instr('0123456789abcdef', substr(qhex, i, 1)) - 1) * 2 + 10) / CAST(10 AS DOUBLE)), 0.75) AS p FROM b)
SELECT sample_id, ref_id, CAST(count(*) // 32 AS BIGINT) AS n_reads, round(sum(p) / (count(*) // 32), 6) AS errors FROM e GROUP BY 1, 2""",
    "sam_round_trip": f"""WITH {READS}
SELECT concat_ws('-', 'r', sample_id, seq) AS qname, CAST(flag AS INTEGER) AS flag, 'ref' || ref_id AS ref_name, pos, mapq, cigar, '*' AS next_ref_name, seq,
  CAST(list_sum(list_transform(range(1, 33), lambda i: (instr('0123456789abcdef', substr(qhex, i, 1)) - 1) * 2 + 10)) AS BIGINT) AS qualities, CAST(mapq % 7 AS BIGINT) AS nm, 's' || sample_id AS rg
FROM reads""",
    "fasta_round_trip": """SELECT 'part' || p_partkey || ' ' || p_name AS ref_name, translate(repeat(md5(CAST(p_partkey AS VARCHAR)), 3), '0123456789abcdef', 'ACGTACGTACGTACGT') AS sequence FROM part""",
    "swarm_round_trip": f"""WITH {CODONS}, c AS (SELECT sample_id, ref_id, position, codon, count(*) AS n FROM masked WHERE q1 > 0 AND q2 > 0 AND q3 > 0 GROUP BY ALL
), s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY sample_id, ref_id, position) AS BIGINT) AS coverage FROM c)
SELECT sample_id, ref_id, position, codon, round(n / CAST(coverage AS DOUBLE), 6) AS freq, coverage, 'sample ' || sample_id AS note FROM s""",
    "variant_grid": f"""WITH {CODONS}, {REFERENCE}, {REF_CODONS}, {CODE}, {FEATURES}, m AS (
  SELECT p AS position, feature, start_, row_number() OVER (PARTITION BY p ORDER BY end_ - start_, row_no) AS r
  FROM range(1, 545) t(p) JOIN features ON p BETWEEN start_ AND end_
)
SELECT k.ref_id, k.position, b.codon, feature || '-' || coalesce(a.aa, '?') || CAST((k.position - start_) // 3 + 1 AS VARCHAR) || b.aa AS label
FROM ref_codons k JOIN m ON m.position = k.position AND r = 1 AND (k.position - start_) % 3 = 0 LEFT JOIN code a ON a.codon = k.ref_codon CROSS JOIN code b""",
    "isotonic_price": """WITH r AS (
  SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, round(l_extendedprice * 100) AS y, row_number() OVER w AS i, sum(round(l_extendedprice * 100)) OVER (w ROWS UNBOUNDED PRECEDING) AS s
  FROM lineitem WINDOW w AS (PARTITION BY l_suppkey, l_returnflag ORDER BY l_quantity, round(l_extendedprice * 100), l_orderkey, l_linenumber)
), m AS (
  SELECT l_suppkey, l_returnflag, a.i AS a, b.i AS b, (b.s - a.s + a.y) / (b.i - a.i + 1) AS mean FROM r a JOIN r b USING (l_suppkey, l_returnflag) WHERE a.i <= b.i
), low AS (SELECT l_suppkey, l_returnflag, b AS i, min(mean) OVER (PARTITION BY l_suppkey, l_returnflag, a ORDER BY b DESC) AS low FROM m
), f AS (SELECT l_suppkey, l_returnflag, i, max(low) AS fit FROM low GROUP BY ALL)
SELECT l_orderkey, l_linenumber, fit FROM r JOIN f USING (l_suppkey, l_returnflag, i)""",
}
