"""Hand-computed cases and degenerate rows."""

import math

import pytest
from pyspark.sql import functions as F

from duoscope.functions import identifiers as ids
from duoscope.operators import bands, calibration, embedding, geometry, maps, ranking, spectra, statistics
from duoscope.sources import tables


def quad(spark, rows):
    return spark.createDataFrame([(k, *[[float(x) for x in v] if v is not None else None for v in vs]) for k, *vs in rows], "k int, WT array<double>, M1 array<double>, M2 array<double>, M12 array<double>")


def test_geometry_of_degenerate_pairs(spark):
    df = quad(spark, [(1, [0, 0], [1, 0], [0, 1], [1, 1]), (2, [1, 1], [1, 1], [1, 1], [1, 1]), (3, [0, 0], [1, 0], [-1, 0], [0, 2]), (4, [0, 0], [1, 0], None, [1, 1]), (5, [0, 0], [1, 0], [1], [1, 1])])
    m = {r.k: r for r in geometry.pair_metrics(df, ["k"]).collect()}
    assert m[1].epi_R_raw == 0 and m[1].magnitude_ratio == 1 and m[1].log_magnitude_ratio == 0
    assert m[2].len_WT_M1 == 0 and m[2].cos_v1_v2 == 0
    assert 40 < m[3].log_magnitude_ratio < math.inf
    assert m[4].epi_R_raw is None and m[5].epi_R_raw is None


def test_identifiers(spark):
    rows = ["G:1:5:A:C", "G:1:5:A:C:P", "G:1:5:A:C:N", "G:1:5:A:C:?", "G:1:5:A", "G:1:x:A:C"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "m string").select(ids.parse_mutation(F.col("m"))).collect()]
    assert [g and g.rev for g in got] == [False, False, True, False, None, None]
    pairs = ["G:1:5:A:C|G:1:9:A:C", "G:1:5:A:C|G:2:9:A:C", "G:1:5:A:C:P|G:1:9:A:C:N", "G:1:5:A:C"]
    got = [r[0] is not None for r in spark.createDataFrame([(r,) for r in pairs], "m string").select(ids.parse_pair(F.col("m"))).collect()]
    assert got == [True, False, False, False]


def test_ordering_swaps_all_paired_columns(spark):
    df = spark.createDataFrame([(9, 3, 90, 30, "b", "a", 7)], "pos1 int, pos2 int, pos1_hg38 int, pos2_hg38 int, snp_id1 string, snp_id2 string, n int")
    assert tuple(tables.ordered_pairs(df).first()) == (3, 9, 30, 90, "a", "b", 7)


def test_allele_repair(spark):
    df = spark.createDataFrame([("1", 1, "A", "G"), ("1", 2, "G", "A"), ("1", 3, "T", "C"), ("1", 4, "C", "-"), ("1", 5, "A", "C")], "chrom string, pos int, ref string, alt string")
    base = spark.createDataFrame([("1", k, "A") for k in (1, 2, 3, 4)], "chrom string, pos int, base string")
    got = {r.pos: (r.ref, r.alt, r.status) for r in tables.repaired_alleles(df, base).collect()}
    assert got == {1: ("A", "G", "match"), 2: ("A", "G", "swapped"), 3: ("A", "G", "complement"), 4: ("C", "-", "unresolved"), 5: ("A", "C", "unknown")}


def test_band_join_edges(spark):
    a = spark.createDataFrame([("x", 98)], "k string, p int")
    b = spark.createDataFrame([("x", q) for q in (98, 99, 108, 109, 88)], "k string, q int")
    assert sorted(r.q for r in bands.band_join(a, b, ["k"], "p", "q", 10).collect()) == [99, 108]
    assert sorted(r.q for r in bands.near_join(a, b, ["k"], "p", "q", 10).collect()) == [88, 99, 108]


def test_tied_q_values(spark):
    df = spark.createDataFrame([(k, p, "t") for k, p in enumerate((0.01, 0.01, 0.04, 0.5))], "k int, p double, t string")
    q = [r.q for r in ranking.bh_fdr(df, "p", ["t"], ["k"]).orderBy("k").collect()]
    assert q == pytest.approx([0.02, 0.02, 0.16 / 3, 0.5])


def test_empirical_p(spark):
    df = spark.createDataFrame([("a", 3.0, False), ("a", None, False), *[("a", float(x), True) for x in (1, 2, 3, 4)], ("b", 1.0, False)], "s string, v double, n boolean")
    got = {(r.s, r.v): r.p for r in statistics.empirical_p(df, "v", "n", ["s"]).collect()}
    assert got == {("a", 3.0): 0.6, ("a", None): None, ("b", 1.0): None}


def test_fisher_greater(spark):
    df = spark.createDataFrame([(8, 4, 4, 3), (10, 0, 3, 0)], "n int, m int, d int, k int")
    assert [r.p for r in statistics.hypergeometric_tail(df, "n", "m", "d", "k").collect()] == pytest.approx([17 / 70, 1.0])


def test_survival(spark):
    df = spark.createDataFrame([(g, t, e) for g in (0, 1) for t, e in ((1.0, 1), (2.0, 0), (3.0, 1), (None, 1))], "grp int, duration double, event int").withColumn("t", F.lit("x"))
    assert statistics.log_rank(df, ["t"]).first().chi2 == 0
    assert [r.survival for r in statistics.kaplan_meier(df.where("grp = 0"), ["t"]).orderBy("duration").collect()] == pytest.approx([2 / 3, 0.0])


def test_brackets(spark):
    df = spark.createDataFrame([("a", "((..))"), ("b", "([)]"), ("c", "()()")], "id string, s string")
    got = sorted(tuple(r) for r in maps.bracket_pairs(df, ["id"], "s").collect())
    assert got == [("a", 0, 5), ("a", 1, 4), ("b", 0, 2), ("b", 1, 3), ("c", 0, 1), ("c", 2, 3)]


@pytest.mark.parametrize(("length", "count"), [(74, 24309), (90, 36045)])
def test_all_doubles(spark, length, count):
    df = spark.createDataFrame([("a", "ACGT" * 25)], "id string, s string").withColumn("s", F.substring("s", 1, length))
    assert maps.double_substitutions(df, ["id"], "s", length).count() == count
    assert maps.single_substitutions(df, ["id"], "s").count() == 3 * length


def test_few_rows_still_invert(spark):
    df = spark.createDataFrame([("m", [1.0, 2.0, 3.0, 4.0]), ("m", [2.0, 1.0, 0.0, 4.0]), ("m", [0.0, 1.0, 5.0, 2.0])], "k string, v array<double>")
    g = calibration.gram(df, ["k"], "v")
    cells = calibration.shrunk(calibration.covariance(g, ["k"], divisor=0), calibration.shrinkage(df, g, ["k"], "v"), ["k"], 1e-6)
    assert spectra.inverse(spectra.in_blocks(cells, ["k"]), ["k"]).select("h", "w").collect() == [(4, 4)]


def test_embedding_store(spark, tmp_path):
    df = spark.createDataFrame([("a", "WT", "ACGTAC"), ("b", "WT", "ACGN")], "id string, role string, seq string")
    out = {r.id: r for r in embedding.embed(df, "seq", embedding.kmer_model, ["id"]).collect()}
    assert out["a"].error is None and out["b"].embedding is None and out["b"].error
    for _ in range(2):  # the second run finds its work done
        embedding.embed_into(spark, str(tmp_path / "store"), df, "seq", embedding.kmer_model)
    s = spark.read.parquet(str(tmp_path / "store"))
    assert [r.id for r in s.collect()] == ["a"]
    assert [r.id for r in embedding.missing(df, s, "id").collect()] == ["b"]


def test_alleles_of_several_bases(spark):
    from duoscope.sources.tables import repaired_alleles

    bases = spark.createDataFrame([("1", 10 + k, b) for k, b in enumerate("ACGT")], "chrom string, pos long, base string")
    rows = [("1", 10, "ACG", "A"), ("1", 10, "TT", "AC"), ("1", 10, "T", "GG"), ("1", 11, "-", "A"), ("1", 12, "GTA", "G"), ("1", 10, "GA", "TT")]
    got = {(r.pos, r.ref, r.alt, r.status) for r in repaired_alleles(spark.createDataFrame(rows, "chrom string, pos long, ref string, alt string"), bases).collect()}
    assert got == {(10, "ACG", "A", "match"), (10, "AC", "TT", "swapped"), (10, "A", "GG", "complement"), (11, "-", "A", "match"), (12, "GTA", "G", "unknown"), (10, "GA", "TT", "unresolved")}


def test_strands(spark):
    from pyspark.sql import functions as F

    from duoscope.functions.identifiers import strand_of, strand_reverse

    words = ["-", "N", " Neg ", "negative", "reverse", "rev", "-1", "+", "P", "positive", "pos", "forward", "fwd", "1", "", None, "odd"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "s string").select(strand_reverse(F.col("s"))).collect()]
    assert got == [True] * 7 + [False] * 9 + [None]
    nums = spark.createDataFrame([(1, True), (0, False), (None, None)], "n int, b boolean").select(strand_of(F.col("n"), "int"), strand_of(F.col("b"), "boolean")).collect()
    assert [tuple(r) for r in nums] == [(True, True), (False, False), (False, False)]
    with pytest.raises(Exception, match="unknown strand"):
        spark.createDataFrame([("odd",)], "s string").select(strand_of(F.col("s"), "string")).collect()


def test_p_values_of_known_statistics(spark):
    from pyspark.sql import functions as F

    from duoscope.operators.statistics import chi2_tail, normal_tail

    r = spark.createDataFrame([(1.959964, 3.841459), (0.0, 0.0), (2.326348, 6.634897)], "z double, x double").select(normal_tail(F.col("z")), chi2_tail(F.col("x"))).collect()
    assert [round(v, 6) for x in r for v in x] == [0.025, 0.05, 0.5, 1.0, 0.01, 0.01]


def test_brackets_and_letters(spark):
    from duoscope.operators.maps import bracket_pairs

    df = spark.createDataFrame([(1, "((.A.))a"), (2, "([)]"), (3, "...")], "id int, s string")
    assert {tuple(r) for r in bracket_pairs(df, ["id"], "s").collect()} == {(1, 0, 6), (1, 1, 5), (1, 3, 7), (2, 0, 2), (2, 1, 3)}


def test_sheets_by_model(spark, tmp_path):
    from duoscope.sources.tables import write_sheets

    write_sheets(spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 3.0)], "model string, v double"), str(tmp_path / "sheets"))
    assert sorted(p.name for p in (tmp_path / "sheets").glob("model=*")) == ["model=a", "model=b"]
    assert spark.read.parquet(str(tmp_path / "sheets")).where("model = 'a'").count() == 2
