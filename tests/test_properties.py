"""Property tests: the distributed building blocks agree with brute force on random data,
whatever the number of ranges / partitions; invariants of the risk operators hold."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.operators import features, metrics, profile, windows
from riskloom.operators.util import HASH_M, key_hash

SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

groups = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9), st.integers(-5, 5)),
                  min_size=1, max_size=40)


@SETTINGS
@given(rows=groups, n_ranges=st.integers(1, 7))
def test_running_totals_match_brute_force(spark, rows, n_ranges):
    data = [(i, g, o, float(v)) for i, (g, o, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id int, g int, o int, v double")
    out = windows.running_totals(df, ["g"], ["o", "id"], ["v"], n_ranges=n_ranges)
    got = {r.id: (r.run_v, r.run_n) for r in out.collect()}
    for i, g, o, v in data:
        before = [x for x in data if x[1] == g and (x[2], x[0]) < (o, i)]
        assert got[i][1] == len(before)
        assert math.isclose(got[i][0], sum(x[3] for x in before), abs_tol=1e-9)


@pytest.mark.parametrize("n_ranges", [1, 8])
def test_null_keys_are_a_group_over_all_ranges(spark, n_ranges):
    rng = random.Random(5)
    data = [(i, rng.choice([None, "a"]), rng.choice([None, "b"]), rng.randint(2000, 2004),
             rng.choice([None, rng.random(), rng.random()])) for i in range(120)]
    df = spark.createDataFrame(data, "record_id long, g string, h string, Anio int, v double")
    mean = {r.record_id: r.m for r in windows.prior_row_mean(
        df, ["g", "h"], "v", out="m", n_ranges=n_ranges).collect()}
    coded = windows.ordered_target_statistic(df, "g", "v", 0.5, n_ranges=n_ranges)
    stat = {r.record_id: r.g_ots for r in coded.collect()}
    order = {r.record_id: (r.o, r.record_id) for r in df.select(
        "record_id", key_hash(F.col("record_id"), 42).alias("o")).collect()}
    assert len(mean) == len(stat) == len(data)
    for i, g, h, y, _ in data:
        v = [x[4] for x in data if x[1:3] == (g, h) and (x[3], x[0]) < (y, i) and x[4] is not None]
        assert math.isclose(mean[i], sum(v) / len(v) if v else 0.0, abs_tol=1e-9)
        v = [x[4] or 0.0 for x in data if x[1] == g and order[x[0]] < order[i]]
        assert math.isclose(stat[i], (sum(v) + 0.5) / (len(v) + 1), abs_tol=1e-9)


@SETTINGS
@given(vals=st.lists(st.integers(0, 6), min_size=1, max_size=40), n_ranges=st.integers(1, 5))
def test_average_rank_matches_definition(spark, vals, n_ranges):
    df = spark.createDataFrame([(1, float(v)) for v in vals], "g int, v double")
    got = {r.v: r.avg_rank for r in windows.average_rank(df, ["g"], "v", n_ranges=n_ranges).collect()}
    for v in set(vals):
        less = sum(1 for x in vals if x < v)
        ties = sum(1 for x in vals if x == v)
        assert got[float(v)] == less + (ties + 1) / 2


@SETTINGS
@given(rows=groups, n=st.integers(1, 4), buckets=st.integers(1, 5))
def test_topn_per_group_matches_brute_force(spark, rows, n, buckets):
    data = [(i, g, float(v)) for i, (g, _, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id int, g int, v double")
    out = windows.topn_per_group(df, ["g"], [F.desc("v"), F.asc("id")], n, buckets=buckets)
    got = sorted((r.g, r.rank, r.id) for r in out.collect())
    want = []
    for g in sorted({x[1] for x in data}):
        ranked = sorted([x for x in data if x[1] == g], key=lambda x: (-x[2], x[0]))[:n]
        want += [(g, k + 1, x[0]) for k, x in enumerate(ranked)]
    assert got == sorted(want)


@SETTINGS
@given(ratios=st.lists(st.floats(0, 1), min_size=2, max_size=30))
def test_class_monotone_in_ratio(spark, ratios):
    from riskloom.functions.risk import risk_class
    df = spark.createDataFrame([(r,) for r in ratios], "r double")
    got = sorted((r.r, r.c) for r in df.select("r", risk_class("r").alias("c")).collect())
    assert all(a[1] <= b[1] for a, b in zip(got, got[1:]))
    assert all(0 <= c <= 4 for _, c in got)


@SETTINGS
@given(pairs=st.lists(st.tuples(st.one_of(st.none(), st.floats(-10, 1e4)),
                                st.one_of(st.none(), st.floats(-10, 1e4))), min_size=1, max_size=20))
def test_loss_ratio_bounded(spark, pairs):
    from riskloom.functions.risk import loss_ratio
    df = spark.createDataFrame(pairs, "lost double, sown double")
    for r in df.select(loss_ratio("lost", "sown").alias("x")).collect():
        assert 0.0 <= r.x <= 1.0


def test_null_keys_have_a_prior_year_mean(spark):
    """E2 and E1 agree: rows with a NULL key are one group."""
    rows = [(1, None, "a", 2000, 0.2), (2, None, "a", 2001, 0.4), (3, None, "a", 2002, 0.0),
            (4, "k", "a", 2001, 1.0), (5, None, None, 2001, 0.6), (6, None, None, 2003, 0.1)]
    df = spark.createDataFrame(rows, "record_id long, k string, m string, Anio int, proporcion_siniestro double")
    got = {r.record_id: r for r in windows.prior_year_mean(df, ["k", "m"]).collect()}
    e1 = {r.record_id: r.hist_mean_rows for r in windows.prior_row_mean(df, ["k", "m"]).collect()}
    assert len(got) == 6 and got[1].k is None and got[1].m == "a"
    want = {1: 0.0, 2: 0.2, 3: 0.3, 4: 0.0, 5: 0.0, 6: 0.6}
    assert {i: round(r.hist_mean, 12) for i, r in got.items()} == want
    assert {i: round(v, 12) for i, v in e1.items()} == want


def test_prior_year_mean_never_reads_same_year(spark):
    rng = random.Random(5)
    data = [(i, rng.choice("AB"), "c", "p", "m", rng.randint(2000, 2004), rng.random()) for i in range(80)]
    df = spark.createDataFrame(data, "record_id long, Nomestado string, Nomcultivo string, "
                                     "Nomcicloproductivo string, Nommodalidad string, Anio int, "
                                     "proporcion_siniestro double")
    keys = ["Nomestado", "Nomcultivo", "Nomcicloproductivo", "Nommodalidad"]
    got = {r.record_id: r.hist_mean for r in windows.prior_year_mean(df, keys).collect()}
    for i, s, *_, y, _r in data:
        prev = [x[6] for x in data if x[1] == s and x[5] < y]
        assert math.isclose(got[i], sum(prev) / len(prev) if prev else 0.0, abs_tol=1e-12)
    # changing the current year's labels never changes that year's feature
    df2 = df.withColumn("proporcion_siniestro", F.when(F.col("Anio") == 2004, 0.0)
                        .otherwise(F.col("proporcion_siniestro")))
    got2 = {r.record_id: r.hist_mean for r in windows.prior_year_mean(df2, keys).collect()}
    assert all(got[i] == got2[i] for i, *_ in data if _[4] == 2004)


def test_stratified_folds_balanced(spark):
    rng = random.Random(7)
    data = [(i, rng.choice([0] * 8 + [1, 2])) for i in range(500)]
    df = spark.createDataFrame(data, "record_id long, target int")
    out = features.stratified_folds(df, "target", 5, 42, n_ranges=7).collect()
    assert len(out) == 500
    for c in (0, 1, 2):
        sizes = [sum(1 for r in out if r.target == c and r.fold == f) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_encodings_ignore_test_rows(spark):
    train = spark.createDataFrame([("a", 0.2), ("a", 0.4), ("b", 1.0)], "c string, y double")
    test = spark.createDataFrame([("a", 9.0), ("z", 9.0)], "c string, y double")
    te = {r.c: r.c_te for r in features.target_encode(train, test, ["c"], "y", m=2.0).collect()}
    g = (0.2 + 0.4 + 1.0) / 3
    assert math.isclose(te["a"], (0.6 + 2 * g) / 4) and math.isclose(te["z"], g)
    od = {r.c: r.c_ord for r in features.ordinal_encode(train, test, ["c"]).collect()}
    assert od == {"a": 0, "z": -1}


def test_ordered_target_statistic_excludes_own_label(spark):
    rng = random.Random(2)
    data = [(i, rng.choice("xy"), rng.random()) for i in range(60)]
    df = spark.createDataFrame(data, "record_id long, cat string, y double")
    a = {r.record_id: r.cat_ots for r in windows.ordered_target_statistic(df, "cat", "y", 0.5).collect()}
    flipped = df.withColumn("y", F.when(F.col("record_id") == 10, 100.0).otherwise(F.col("y")))
    b = {r.record_id: r.cat_ots for r in windows.ordered_target_statistic(flipped, "cat", "y", 0.5).collect()}
    assert a[10] == b[10]


@SETTINGS
@given(pairs=st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=1, max_size=60))
def test_label_metrics_bounded_and_exact(spark, pairs):
    s = spark.createDataFrame([(i, y, p) for i, (y, p) in enumerate(pairs)], "key long, y int, yhat int")
    m = metrics.label_metrics(metrics.confusion_long(s)).first()
    n = len(pairs)
    assert math.isclose(m.accuracy, sum(y == p for y, p in pairs) / n)
    for v in (m.accuracy, m.balanced_accuracy, m.f1_macro, m.f1_weighted, m.f2_critical):
        assert 0.0 <= v <= 1.0 + 1e-12
    assert -1.0 - 1e-12 <= m.mcc <= 1.0 + 1e-12
    # balanced accuracy = mean recall over classes present in y
    present = sorted({y for y, _ in pairs})
    rec = [sum(1 for y, p in pairs if y == c and p == c) / sum(1 for y, _ in pairs if y == c) for c in present]
    assert math.isclose(m.balanced_accuracy, sum(rec) / len(rec))


def test_threshold_sweep_matches_direct_rescoring(spark):
    rng = random.Random(11)
    rows = []
    for i in range(120):
        w = [rng.randint(1, 9) for _ in range(5)]
        p = [v / sum(w) for v in w]
        rows.append((i, rng.randrange(5), max(range(5), key=lambda k: (p[k], -k)), p))
    s = spark.createDataFrame(rows, "key long, y int, yhat int, p array<double>")
    sweep = {r.i: r for r in metrics.threshold_sweep(s, n=7).collect()}
    taus = metrics.linspace(0.02, 0.9, 7)
    for i, t in enumerate(taus, start=1):
        direct = s.withColumn("yhat", F.when(F.col("p")[4] >= t, 4).otherwise(F.col("yhat")))
        d = metrics.label_metrics(metrics.confusion_long(direct)).first()
        assert math.isclose(sweep[i].composite, d.composite, abs_tol=1e-12)


def test_key_hash_is_deterministic_and_spread(spark):
    df = spark.range(1000).select(key_hash(F.col("id"), 42).alias("h"))
    hs = [r.h for r in df.collect()]
    assert len(set(hs)) == 1000 and min(hs) >= 0
    assert 0.35 < sum(1 for h in hs if h < HASH_M // 2) / 1000 < 0.65


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_results_invariant_to_partitioning(spark, parts):
    from riskloom.plans.registry import load_all
    from conftest import SF_SMALL
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        reg = load_all()
        rows = {n: sorted(map(tuple, reg[n].fn(spark, SF_SMALL).collect()), key=str)
                for n in ("prior_row_mean", "roc_auc", "correlation_matrix", "stratified_folds")}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    if parts == 1:
        test_results_invariant_to_partitioning.base = rows
    else:
        assert rows == test_results_invariant_to_partitioning.base


@SETTINGS
@given(vals=st.lists(st.tuples(st.integers(0, 2), st.integers(-3, 3)), min_size=1, max_size=40),
       n_ranges=st.integers(1, 5))
def test_exact_quantiles_match_linear_interpolation(spark, vals, n_ranges):
    from riskloom.operators.quantiles import exact_quantiles
    df = spark.createDataFrame([(g, float(v)) for g, v in vals], "g int, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {(r.g, r.prob): r.q for r in exact_quantiles(df, "v", probs, ["g"], n_ranges).collect()}
    for g in {g for g, _ in vals}:
        s = sorted(float(v) for gg, v in vals if gg == g)
        for p in probs:
            pos = (len(s) - 1) * p
            lo, hi = math.floor(pos), math.ceil(pos)
            want = s[lo] if lo == hi else s[lo] * (1 - (pos - lo)) + s[hi] * (pos - lo)
            assert math.isclose(got[(g, p)], want, abs_tol=1e-12)


def _avg_ranks(xs):
    order = sorted(range(len(xs)), key=lambda i: xs[i])
    ranks = [0.0] * len(xs)
    i = 0
    while i < len(order):
        j = i
        while j + 1 < len(order) and xs[order[j + 1]] == xs[order[i]]:
            j += 1
        for t in range(i, j + 1):
            ranks[order[t]] = (i + j) / 2 + 1
        i = j + 1
    return ranks


def _pearson(a, b):
    n = len(a)
    ma, mb = sum(a) / n, sum(b) / n
    cov = sum((x - ma) * (y - mb) for x, y in zip(a, b))
    va = sum((x - ma) ** 2 for x in a)
    vb = sum((y - mb) ** 2 for y in b)
    return None if va == 0 or vb == 0 else cov / math.sqrt(va * vb)


def test_spearman_matches_brute_force_with_nulls(spark):
    from riskloom.operators.profile import correlation_matrix
    rng = random.Random(4)
    rows = []
    for _ in range(70):
        a = float(rng.randint(0, 6))
        b = None if rng.random() < 0.2 else float(rng.randint(0, 9))
        c = None if rng.random() < 0.3 else a * 2 + rng.random()
        rows.append((a, b, c))
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r.col_a, r.col_b): r.corr for r in correlation_matrix(df, ["a", "b", "c"]).collect()}
    cols = {"a": 0, "b": 1, "c": 2}
    for x, i in cols.items():
        for y, j in cols.items():
            pairs = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
            want = _pearson(_avg_ranks([p[0] for p in pairs]), _avg_ranks([p[1] for p in pairs]))
            assert math.isclose(got[(x, y)], want, abs_tol=1e-9), (x, y)


def _counted(df):
    """``df`` and an accumulator of the rows that are made of it."""
    made = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b
    return df.mapInArrow(run, df.schema), made


def test_score_points_read_the_scored_table_once(spark):
    rows = [(i % 5, [((i * (k + 3)) % 7 + 1) / 10 for k in range(5)]) for i in range(60)]
    df, made = _counted(spark.createDataFrame(rows, "y int, p array<double>"))
    metrics.average_precision_macro(df).collect()
    assert made.value == len(rows)


def test_correlation_ranks_a_value_once_for_all_masks(spark, monkeypatch):
    seen = []
    kept = profile.running_totals

    def spy(df, *args, **kwargs):
        seen.append(df.count())
        return kept(df, *args, **kwargs)
    monkeypatch.setattr(profile, "running_totals", spy)
    rows = [(float(i % 6), float(i * i % 11), None if i % 4 == 0 else float(i * 7 % 10)) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r.col_a, r.col_b): r["corr"] for r in profile.correlation_matrix(df, ["a", "b", "c"]).collect()}
    want = df.toPandas()
    assert seen == [sum(want[c].nunique() for c in want)]
    for (a, b), r in got.items():
        both = want[[a, b]].dropna() if a != b else want[[a]].dropna()
        x, y = both[a].rank(), both[b].rank()
        assert abs(r - x.corr(y)) < 1e-9
