"""Work of a task stays bounded while tables grow."""

from pyspark.sql import functions as F

from duoscope.operators import bands
from duoscope.plans import standins


def test_pairs_of_one_group_are_dealt_over_tasks(spark):
    df = spark.range(700).select(F.lit("g").alias("g"), F.col("id").alias("m")).unionByName(spark.createDataFrame([("h", 5), (None, 6), ("h", None)], "g string, m long"))
    got = bands.combinations(df, ["g"], "m", block=50, task=10_000)
    assert got.count() == got.distinct().count() == 700 * 699 // 2
    assert got.where("m1 >= m2").isEmpty()
    assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 700 * 699 // 2 / 4


def test_calls_by_bounded_tasks_are_the_same_calls(spark, sf):
    few = standins.calls(spark, sf, 5000)
    assert few.exceptAll(standins.calls(spark, sf)).isEmpty() and few.count() == standins.calls(spark, sf).count()
    assert few.rdd.getNumPartitions() > 8


def test_short_answers_of_a_model_share_frames(spark):
    from duoscope.operators import embedding

    df = spark.createDataFrame([(k, "ACGT" * (k % 3)) for k in range(90)], "id long, seq string").coalesce(1)
    got = embedding.long_arrays(df, lambda: lambda r: {"n": [len(r["seq"])] * (r["id"] % 4)}, ["id"], "n int")
    assert sorted(map(tuple, got.collect())) == [(k, len("ACGT" * (k % 3))) for k in range(90) for _ in range(k % 4)]


def test_texts_are_spelled_once_a_read_and_by_ascii_letters_alone(spark, tmp_path):
    from duoscope.plans import genome

    rows = [(1, "aZKİ z-Bﬁc"), (2, None), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    s = genome.spelled(spark, str(tmp_path))
    assert {r.doc_id: r.seq for r in s.collect()} == {1: "ANNCG", 2: "", 3: ""}
    plan = s.where(F.length("seq") > 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("spelling(") == 1


def shuffled_values(spark):
    """Two strata of uneven bins, among them null bins, values and labels."""
    rows = [("s" if k % 7 else "t", None if k % 11 == 0 else int(k % 5 == 0), k, None if k % 13 == 0 else float(k * k % 101), None if k % 17 == 0 else k % 3 == 0) for k in range(900)]
    return rows, spark.createDataFrame(rows, "s string, b int, k long, v double, g boolean")


def test_shuffles_of_a_bin_are_not_sorted_in_its_task(spark):
    from duoscope.operators import statistics as st

    plan = st.permutation_test(shuffled_values(spark)[1], "v", "g", "b", "k", 20, ["s"])._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    made = [k for k, line in enumerate(plan) if line.lstrip(" :+-").startswith("Generate")]
    assert made
    for k in made:
        above = []
        for line in plan[k::-1]:
            if not above or depth(line) < depth(above[-1]):
                above.append(line)
        # What is made of a row is cut or added up before a window sees it, and rows are dealt by number.
        assert "Filter" in above[1] + above[2] or "Aggregate" in above[1] + above[2]
        assert any("RepartitionByExpression" in line for line in plan[k:])


def test_shuffles_within_bins_match_brute_force(spark):
    import statistics
    from hashlib import md5

    from duoscope.operators import statistics as st

    rows, df = shuffled_values(spark)
    got = {r.s: r for r in st.permutation_test(df, "v", "g", "b", "k", 40, ["s"]).collect()}

    def gap(pairs):
        one, two = [v for v, g in pairs if g and v is not None], [v for v, g in pairs if g is False and v is not None]
        return sum(one) / len(one) - sum(two) / len(two)

    for s in ("s", "t"):
        bins = {}
        for r in rows:
            if r[0] == s:
                bins.setdefault(r[1], []).append(r)
        mean = {b: statistics.fmean(r[3] for r in m if r[3] is not None) for b, m in bins.items()}
        off = lambda r: None if r[3] is None else r[3] - mean[r[1]]
        seen, runs = gap([(off(r), r[4]) for m in bins.values() for r in m]), []
        for p in range(1, 41):
            shuffled = []
            for m in bins.values():
                n = sum(r[4] is True for r in m)
                order = sorted(m, key=lambda r: md5(f"{p}:{r[2]}".encode()).hexdigest())
                shuffled += [(off(r), k < n) for k, r in enumerate(order)]
            runs.append(gap(shuffled))
        assert abs(got[s].observed - seen) < 1e-9
        assert abs(got[s].z - (seen - statistics.fmean(runs)) / statistics.stdev(runs)) < 1e-9
        assert got[s].p == (sum(d >= seen for d in runs) + 1) / 41


def test_texts_are_spelled_and_embedded_a_few_at_a_time(spark, tmp_path):
    import tracemalloc

    from duoscope.operators import embedding
    from duoscope.plans import genome

    def load():
        tracemalloc.start()
        return lambda texts: [[tracemalloc.get_traced_memory()[1] / 2**20] for _ in texts]

    df = spark.range(6000).coalesce(1).select("id", F.repeat(F.concat(F.lit("ACGT"), F.col("id").cast("string")), 500).alias("seq"))
    got = embedding.embed(df, "seq", load, ["id"]).agg(F.count("embedding").alias("n"), F.max(F.element_at("embedding", 1)).alias("most")).first()
    size = df.agg(F.sum(F.length("seq"))).first()[0] / 2**20
    # What Spark sends at once is held as bytes, once.
    assert got.n == 6000 and got.most < 1.3 * size
    df.select(F.col("id").alias("doc_id"), F.col("seq").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    plan = genome.spelled(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_genotypes_of_few_places_share_batches_and_do_not_move(spark):
    import numpy as np

    from duoscope.operators import substitution

    seqs = ["".join("ACGTN"[(k // 5**p) % 5] for p in range(5)) for k in range(300)]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(seqs + seqs[:40])], "id long, seq string")
    texts, calls = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def load():
        inner = substitution.composition_model()

        def model(batch):
            if any("NNA" in t for t in batch):
                raise ValueError("a base is missing")
            texts.add(len(batch))
            calls.add(1)
            return inner(batch)

        return model

    def scores(whole, batch):
        s = substitution.epistasis_scores(df, ["id"], "seq", load, batch=batch, positions=[0, 2, 3, 9], whole=whole)
        return {tuple(r)[:5]: r.score for r in s.collect()}

    one = scores(3, 50)
    singles = [sum(3 + (s[p] == "N") for p in (0, 2, 3)) for s in seqs]
    doubles = [sum((3 + (s[p] == "N")) * (3 + (s[q] == "N")) for p, q in ((0, 2), (0, 3), (2, 3))) for s in seqs]
    assert len(one) == sum(doubles) + sum(doubles[:40]) and {k[:3] for k in one} == {(k, i, j) for k in range(340) for i, j in ((0, 2), (0, 3), (2, 3))}
    # Sequences of more places than that are spread, with the same scores, also where the model fails.
    many = scores(2, 50)
    assert many.keys() == one.keys() and None in one.values()
    assert all((one[k] is None) == (many[k] is None) and (one[k] is None or abs(one[k] - many[k]) < 1e-12) for k in one)
    # A model without failures gets full batches, and each genotype once.
    load_all = substitution.composition_model

    def counted():
        inner = load_all()

        def model(batch):
            texts.add(len(batch))
            calls.add(1)
            return inner(batch)

        return model

    texts.value = calls.value = 0
    s = substitution.epistasis_scores(df, ["id"], "seq", counted, batch=500, positions=[0, 2, 3, 9])
    assert s.count() == len(one)
    assert texts.value == len(seqs) + sum(singles) + sum(doubles) and calls.value <= texts.value / 500 + 2 * 8
    assert s._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    m = {(r.id, r.pos_i, r.pos_j): (r.score, r.n) for r in substitution.epistasis_maps(df, ["id"], "seq", counted, positions=[0, 2, 3, 9]).collect()}
    assert m == {(r.id, r.pos_i, r.pos_j): (r.score, r.n) for r in substitution.epistasis_map(s, ["id"]).collect()} and len(m) == 340 * 6
    got = load_all()(["", "ACGTN", "é", "GG"])
    assert np.allclose(got, [[0, 0, 0, 0], [1, 1, 0.25, 0.25], [0, 0, 0, 0], [0, 0, 2, 0]])
