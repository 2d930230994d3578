"""Edge cases on small hand-made fixtures (FIXTURES.md X1-X10), expected values by hand."""

import math

import pytest
from pyspark.sql import functions as F

from riskloom.operators import clean, climate, cluster, joins, metrics, profile, windows
from riskloom.sources import files

# -- X2: loss ratio, class, imputation, duplicates --------------------------------------

X2 = [  # Sembrada, Siniestrada, Cosechada, Precio, ratio, class, Precio after imputation
    (100.0, 0.0, 100.0, 5.0, 0.0, 0, 5.0),
    (100.0, 10.0, 90.0, 5.0, 0.10, 1, 5.0),
    (100.0, 10.01, 89.99, 5.0, 0.1001, 2, 5.0),
    (100.0, 40.0, 60.0, 5.0, 0.40, 2, 5.0),
    (100.0, 75.0, 25.0, 5.0, 0.75, 3, 5.0),
    (100.0, 76.0, 24.0, 5.0, 0.76, 4, 5.0),
    (100.0, 120.0, 0.0, None, 1.0, 4, 0.0),
    (0.0, 5.0, 0.0, None, 0.0, 0, 0.0),
    (None, 5.0, 3.0, None, 0.0, 0, None),
]


@pytest.fixture()
def x2(spark):
    rows = [(i, *r[:4]) for i, r in enumerate(X2)]
    return spark.createDataFrame(rows, "id int, Sembrada double, Siniestrada double, "
                                       "Cosechada double, Precio double")


def test_ratio_class_and_imputation(x2):
    out = clean.impute_structural_nulls(clean.with_risk(x2)).orderBy("id").collect()
    for row, exp in zip(out, X2):
        assert math.isclose(row.proporcion_siniestro, exp[4], abs_tol=1e-12)
        assert row.target == exp[5]
        assert row.Precio == exp[6]
    assert out[6].nivel_riesgo == "Pérdida crítica" and out[0].nivel_riesgo == "Sin siniestro"


def test_missing_inputs_give_empty_ratio(spark, x2):
    assert clean.with_loss_ratio(x2.drop("Siniestrada")).count() == 0


def test_residual_nulls_dropped(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (1.0, None)], "Sembrada double, Volumenproduccion double")
    assert clean.drop_residual_nulls(df).count() == 1


def test_duplicates(x2):
    doubled = x2.unionByName(x2.filter("id = 1"))
    d = profile.duplicate_count(doubled.drop("id")).first()
    assert d.n_duplicates == 1 and d.n_rows == 10
    assert profile.duplicate_count(doubled.drop("id").filter("Sembrada IS NULL").unionByName(
        doubled.drop("id").filter("Sembrada IS NULL"))).first().n_duplicates == 1  # NULL = NULL
    assert clean.drop_residual_nulls(doubled, ["Precio"]).count() == 7
    from riskloom.operators.sorting import drop_duplicates
    assert drop_duplicates(doubled.drop("id")).count() == 9


# -- B7/B8: text folding and label mapping -----------------------------------------------

@pytest.mark.parametrize("text,cls", [
    ("Pérdida crítica", 4), ("PÃ©rdida crÃ­tica", 4), ("pardida cratica", 4), ("RIESGO MEDIO", 2),
    ("Riesgo bajo", 1), ("Riesgo alto", 3), ("Sin siniestro", 0), ("", 0), ("nan", 0), (None, 0)])
def test_label_to_class(spark, text, cls):
    from riskloom.functions.risk import label_to_class
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(label_to_class("t").alias("c")).first().c == cls


def test_label_missing_variant_is_null(spark):
    from riskloom.functions.risk import label_to_class
    df = spark.createDataFrame([("",), (None,), ("nan",), ("alto",)], "t string")
    got = [r.c for r in df.select(label_to_class("t", missing=None).alias("c")).collect()]
    assert got == [None, None, None, 3]


def test_normalize_text(spark):
    from riskloom.functions.risk import normalize_text
    df = spark.createDataFrame([("  Otoño-Invierno ",), ("PÃ©rdida",)], "t string")
    assert [r.n for r in df.select(normalize_text("t").alias("n")).collect()] == ["otono-invierno", "pardida"]


def test_apply_types_coerces(spark):
    df = spark.createDataFrame([("2010", "1.5", "n/d"), ("x", "2", "3.25")], "Anio string, Sembrada string, Precio string")
    out = clean.apply_types(df, ["Sembrada", "Precio", "missing"]).collect()
    assert out[0].Anio == 2010 and out[0].Precio is None and out[1].Anio is None and out[1].Precio == 3.25


def test_select_features_refuses_post_harvest(spark, x2):
    with pytest.raises(ValueError):
        clean.select_features(x2, ["Sembrada", "Siniestrada"])


def test_require_columns(x2):
    with pytest.raises(clean.MissingColumnsError):
        clean.require_columns(x2, ["Nomestado"])


def test_temporal_split_disjoint_and_null_year(spark):
    df = spark.createDataFrame([(y,) for y in [2018, 2020, 2021, 2022, 2023, None]], "Anio int")
    tr, va, te = clean.temporal_split(df, 2020, 2022)
    assert (tr.count(), va.count(), te.count()) == (2, 2, 1)


# -- X7: history features ----------------------------------------------------------------

def test_history_fixture(spark):
    rows = [(1, 2010, 0.2), (2, 2010, 0.4), (3, 2011, 0.6), (4, 2012, 0.9)]
    df = spark.createDataFrame([(k, "E", "C", "PV", "T", y, r) for k, y, r in rows],
                               "record_id long, Nomestado string, Nomcultivo string, "
                               "Nomcicloproductivo string, Nommodalidad string, Anio int, "
                               "proporcion_siniestro double")
    keys = ["Nomestado", "Nomcultivo", "Nomcicloproductivo", "Nommodalidad"]
    e2 = {r.record_id: r.hist_mean for r in windows.prior_year_mean(df, keys).collect()}
    e1 = {r.record_id: r.hist_mean_rows for r in windows.prior_row_mean(df, keys, n_ranges=3).collect()}
    for k, v in {1: 0.0, 2: 0.0, 3: 0.3, 4: 0.4}.items():
        assert math.isclose(e2[k], v, abs_tol=1e-12)
    for k, v in {1: 0.0, 2: 0.2, 3: 0.3, 4: 0.4}.items():
        assert math.isclose(e1[k], v, abs_tol=1e-12)


# -- X5 / X6: climate --------------------------------------------------------------------

def test_pet_branches_and_days(spark):
    from riskloom.functions.climate import days_in_month, pet_thornthwaite
    df = spark.createDataFrame([(t, 2000, 2) for t in (None, -1.0, 0.0, 26.5, 10.0)],
                               "t double, year int, month int")
    out = df.select(pet_thornthwaite("t", F.lit(50.0), F.lit(1.2), F.lit(20.0), "year", "month").alias("pet"),
                    days_in_month("year", "month").alias("d")).collect()
    assert [r.pet for r in out[:3]] == [0.0, 0.0, 0.0]
    assert out[0].d == 29  # leap February
    hot = -415.85 + 32.24 * 26.5 - 0.43 * 26.5 * 26.5
    ratio = out[3].pet / hot
    assert 0 < ratio < 2  # scaled by daylight/12 * days/30
    assert out[4].pet > 0


def _monthly(spark, cells, state=1, lat=20.0):
    return spark.createDataFrame(
        [(y, m, state, lat, 3.0 + 0.1 * m, t, t + 6, t - 6, 50.0, 2.0) for y, m, t in cells],
        "year int, month int, Idestado int, lat double, precip_mm_dia double, temp_media_c double, "
        "temp_max_c double, temp_min_c double, humedad_rel_pct double, viento_ms double")


def test_drought_gap_and_history_length(spark):
    cells = [(y, m, 15.0 + m) for y in (2000, 2001) for m in range(1, 13) if (y, m) != (2001, 5)]
    d = climate.drought_index(_monthly(spark, cells)).orderBy("year", "month").collect()
    by = {(r.year, r.month): r for r in d}
    assert by[(2000, 1)].spei_03 is None and by[(2000, 2)].spei_03 is None  # < 3 months of history
    assert by[(2000, 3)].spei_03 is not None
    assert by[(2001, 6)].spei_03 is None and by[(2001, 7)].spei_03 is None  # window spans the gap
    assert by[(2001, 8)].spei_03 is not None
    assert all(r.spei_12 is None for r in d if (r.year, r.month) < (2000, 12))


def test_constant_series_zscore_is_zero(spark):
    df = spark.createDataFrame([(1, m, 5.0) for m in range(4)], "g int, i int, x double")
    out = windows.zscore_by_group(df, "x", ["g"], "z").collect()
    assert all(r.z == 0.0 for r in out)


def test_cycle_rules(spark):
    cells = [(2000, m, 20.0) for m in range(1, 13)] + [(2001, m, 20.0) for m in (1, 2, 3, 10, 11, 12)]
    cyc = joins.climate_by_cycle(climate.drought_index(_monthly(spark, cells)))
    got = {(r.Anio, r.Idciclo): r.n_months for r in cyc.collect()}
    assert got[(2000, 1)] == 6 and got[(2000, 3)] == 12
    assert got[(2000, 2)] == 6          # Oct-Dec 2000 + Jan-Mar 2001
    assert (2001, 2) not in got         # only Oct-Dec 2001: 3 < 4 months
    assert (2001, 3) not in got         # 6 months < 12
    assert (1999, 2) not in got         # Jan-Mar 2000 alone: 3 < 4
    months = joins.cycle_months(_monthly(spark, [(2000, 10, 1.0)])).collect()
    assert sorted(r.Idciclo for r in months) == [1, 2, 3]  # October counts twice (+ perennial)


def test_climate_json_roundtrip(spark):
    cells = [(2000, m, 10.0 + m) for m in range(1, 13)]
    m = _monthly(spark, cells)
    docs = climate.climate_to_json(m.withColumn("temp_min_c", F.when(F.col("month") == 3, None)
                                                .otherwise(F.col("temp_min_c"))))
    back = climate.climate_from_json(docs, m.select("Idestado", "lat").distinct())
    rows = {r.month: r for r in back.collect()}
    assert len(rows) == 12 and rows[3].temp_min_c is None  # -999 -> NULL, month 13 dropped
    assert rows[2].precip_mm_mes == round((3.0 + 0.2) * 29, 2)  # leap year February


def test_climate_join_keeps_rows(spark):
    recs = spark.createDataFrame([(1, 2000, 1, 1), (2, 2000, 1, 2), (3, 2030, 1, 1)],
                                 "record_id int, Anio int, Idestado int, Idciclo int")
    clim = spark.createDataFrame([(2000, 1, 1, 5.0)], "Anio int, Idestado int, Idciclo int, clima_x double")
    out = joins.climate_left_join(recs, clim, check_unique=True)
    assert out.count() == 3 and out.filter("clima_x IS NOT NULL").count() == 1
    cov = joins.join_coverage(out, "clima_x").first()
    assert cov.pct_match == 33.33
    with pytest.raises(joins.JoinContractError):
        joins.climate_left_join(recs, clim.unionByName(clim), check_unique=True)


# -- X3: municipal profile -----------------------------------------------------------------

def test_municipal_profile_edges(spark):
    rows = [("E", "A", 0.09, 0.0, 0.09, "Riego", "c1", 1.0, 1.0, 1.0, 1.0, 1.0),
            ("E", "B", 0.1, 0.05, 0.05, "Temporal", "c1", 1.0, 1.0, 1.0, 1.0, 1.0),
            ("E", "C", 10.0, 1.0, 9.0, "Temporal", "c1", 5.0, 2.0, None, None, 3.0),
            ("E", "C", 10.0, 0.0, 10.0, "Riego", "c2", 5.0, 2.0, None, None, 3.0),
            ("E", None, 50.0, 0.0, 50.0, "Riego", "c1", 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "Nomestado string, Nommunicipio string, Sembrada double, "
                                     "Siniestrada double, Cosechada double, Nommodalidad string, "
                                     "Nomcultivo string, Volumenproduccion double, Valorproduccion double, "
                                     "Precio double, Rendimiento double, x double")
    p = {r.Nommunicipio: r for r in cluster.municipal_profile(df).collect()}
    assert set(p) == {"B", "C"}
    assert p["C"].Precio_medio == 0.0 and p["C"].Diversidad_cultivos == 2
    assert math.isclose(p["C"].prop_temporal, 0.5) and math.isclose(p["C"].proporcion_siniestro_total, 0.05)
    assert math.isclose(p["B"].log_Diversidad_cultivos, math.log(2))


def test_nearest_centroid_and_minmax(spark):
    df = spark.createDataFrame([(0.1, 0.0), (2.0, 2.1), (1.0, 1.0)], "a double, b double")
    out = [r.cluster for r in cluster.nearest_centroid(df, [[0, 0], [2, 2], [1, 1]], ["a", "b"]).collect()]
    assert out == [0, 1, 2]
    s = spark.createDataFrame([(0, 1.0, 5.0), (1, 3.0, 5.0)], "cluster int, x double, y double")
    mm = {r.cluster: r for r in cluster.minmax_profile(s, ["x", "y"]).collect()}
    assert mm[0].x_norm == 0.0 and mm[1].x_norm == 1.0 and mm[0].y_norm == 0.0  # constant -> 0


# -- X9: metrics -----------------------------------------------------------------------------

def _scored(spark, pairs, p=None):
    rows = []
    for i, (y, yh) in enumerate(pairs):
        pv = p[i] if p else [1.0 if k == yh else 0.0 for k in range(5)]
        rows.append((i, y, yh, pv))
    return spark.createDataFrame(rows, "key long, y int, yhat int, p array<double>")


def test_perfect_prediction(spark):
    s = _scored(spark, [(0, 0), (1, 1), (2, 2), (4, 4), (4, 4)])
    m = metrics.label_metrics(metrics.confusion_long(s)).first()
    assert m.accuracy == 1.0 and m.kappa == 1.0 and m.kappa_quadratic == 1.0 and m.mcc == 1.0
    assert m.f1_macro == 1.0 and m.balanced_accuracy == 1.0 and m.f2_critical == 1.0


def test_metrics_against_hand_values(spark):
    # y:    0 0 0 1 4 ; yhat: 0 0 1 1 0  (class 4 never predicted, classes 2, 3 absent)
    s = _scored(spark, [(0, 0), (0, 0), (0, 1), (1, 1), (4, 0)])
    m = metrics.label_metrics(metrics.confusion_long(s)).first()
    assert math.isclose(m.accuracy, 0.6)
    assert math.isclose(m.balanced_accuracy, (2 / 3 + 1 + 0) / 3)
    f1_0 = 2 * (2 / 3) * (2 / 3) / (4 / 3)
    f1_1 = 2 * 0.5 * 1 / 1.5
    assert math.isclose(m.f1_macro, (f1_0 + f1_1 + 0) / 3)
    assert m.f2_critical == 0.0
    cm = {(r.y, r.yhat): (r.n, r.rate) for r in metrics.confusion_matrix(s).collect()}
    assert len(cm) == 25 and cm[(0, 0)] == (2, 2 / 3) and cm[(3, 3)] == (0, 0.0)


def test_auc_matches_pairwise_definition(spark):
    import random
    rng = random.Random(3)
    ys = [rng.randrange(5) for _ in range(60)]
    ps = []
    for _ in ys:
        w = [rng.choice([1, 2, 3]) for _ in range(5)]  # many ties
        ps.append([v / sum(w) for v in w])
    s = _scored(spark, [(y, 0) for y in ys], ps)
    got = {r.k: r.auc for r in metrics.roc_auc(s).collect()}
    for k in range(5):
        pos = [p[k] for y, p in zip(ys, ps) if y == k]
        neg = [p[k] for y, p in zip(ys, ps) if y != k]
        want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
        assert math.isclose(got[k], want, rel_tol=1e-12)


def test_log_loss_and_brier(spark):
    s = _scored(spark, [(0, 0), (1, 0)], [[0.5, 0.5, 0.0, 0.0, 0.0], [0.8, 0.2, 0.0, 0.0, 0.0]])
    ll = metrics.log_loss(s).first().log_loss
    assert math.isclose(ll, (-math.log(0.5) - math.log(0.2)) / 2)
    b = metrics.brier(s).first().brier
    assert math.isclose(b, ((0.25 + 0.25) + (0.64 + 0.64)) / 2)


# -- X10: scoring requests -------------------------------------------------------------------

def test_validate_request(spark):
    rows = [(1, "OAXACA", "Maíz grano", "P-V", "Temporal", 2.5, 4200.0),
            (2, "OAXACA", "Maíz grano", "Primavera-Verano", "Temporal", -1.0, 4200.0),
            (3, None, "Maíz grano", "Primavera-Verano", "Temporal", 2.5, 4200.0),
            (4, "OAXACA", "Maíz grano", "Primavera-Verano", "Temporal", 2.5, -3.0)]
    df = spark.createDataFrame(rows, "record_id int, Nomestado string, Nomcultivo string, "
                                     "Nomcicloproductivo string, Nommodalidad string, Sembrada double, Precio double")
    known = {"Nomcicloproductivo": spark.createDataFrame([("Primavera-Verano",)], "Nomcicloproductivo string")}
    out = {r.record_id: r for r in clean.validate_request(df, known).collect()}
    assert out[1].ok and out[1].flag == "unknown Nomcicloproductivo"
    assert out[2].reason == "negative Sembrada" and out[3].reason == "missing Nomestado"
    assert out[4].reason == "negative Precio" and out[2].flag is None


# -- X1: yearly files --------------------------------------------------------------------------

HEADER = ["Anio", "Idestado", "Nomestado", "Idmunicipio", "Nommunicipio", "Idciclo",
          "Nomcicloproductivo", "Idmodalidad", "Nommodalidad", "Idcultivo", "Nomcultivo",
          "Sembrada", "Cosechada", "Siniestrada", "Volumenproduccion", "Rendimiento", "Precio",
          "Valorproduccion"]


def _row(year, price="5.0"):
    return [str(year), "20", "OAXACA", "1", "Santa María", "1", "Primavera-Verano", "2",
            "Temporal", "7", "Maíz grano", "10", "8", "2", "16", "2", price, "80"]


def test_read_and_integrate_years(spark, workdir):
    import os
    # (a) plain UTF-8 with BOM; (b) renamed columns, Latin-1, reordered, text in a number
    p1 = os.path.join(workdir, "yearly_2010.csv")
    with open(p1, "w", encoding="utf-8-sig") as f:
        f.write(",".join(HEADER) + "\n" + ",".join(_row(2010)) + "\n")
    hdr2 = [("Nomcultivo Sin Um" if h == "Nomcultivo" else "Preciomediorural" if h == "Precio" else h)
            for h in HEADER]
    order = list(reversed(range(len(HEADER))))
    p2 = os.path.join(workdir, "yearly_2011.csv")
    with open(p2, "w", encoding="latin-1") as f:
        f.write(",".join(" " + hdr2[i] + " " for i in order) + "\n")
        f.write(",".join(_row(2011, "n/d")[i] for i in order) + "\n")
    one = files.read_records(spark, p1, encoding="UTF-8").first()
    assert one.Anio == 2010 and one.Precio == 5.0
    df = files.integrate_years(spark, [p2, p1])
    rows = {r.Anio: r for r in df.collect()}
    assert set(rows) == {2010, 2011}
    assert rows[2011].Precio is None and rows[2011].Nomcultivo == "Maíz grano"
    assert rows[2011].Nommunicipio == "Santa María" and rows[2010].Sembrada == 10.0
    with pytest.raises(FileNotFoundError):
        files.read_records(spark, os.path.join(workdir, "missing.csv"))


def test_export_round_trip(spark, workdir, x2):
    import os
    df = clean.with_risk(x2).withColumn("Anio", F.lit(2010))
    with pytest.raises(ValueError):
        files.export_clean(df, os.path.join(workdir, "x"), "xlsx")
    pq = files.export_clean(df, os.path.join(workdir, "clean_pq"), "parquet")
    back = files.read_processed(spark, pq)
    assert back.count() == df.count() and "Anio" in back.columns
    csv = files.export_clean(df, os.path.join(workdir, "clean_csv"), "csv")
    back2 = files.read_processed(spark, csv)
    assert sorted(r.target for r in back2.collect()) == sorted(r.target for r in df.collect())
    enr = files.export_enriched(spark.createDataFrame([(1.234567,)], "x double"), os.path.join(workdir, "enr"))
    assert spark.read.option("header", True).csv(enr).first().x == "1.2346"


def test_state_centroids_and_assembler(spark):
    from pyspark.ml.feature import VectorAssembler
    c = climate.state_centroids(spark)
    assert c.count() == 32 and c.filter("Idestado = 20").first().lat == 17.07
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    asm = VectorAssembler(inputCols=["a", "b"], outputCol="v", handleInvalid="error")
    with pytest.raises(Exception):
        asm.transform(df).collect()  # I8: a missing input is an error, not a silent NaN


def test_overview_approximate_distinct(spark):
    df = spark.range(20000).select((F.col("id") % 5000).alias("a"), F.lit(2000).alias("Anio"))
    exact = {r.column_name: r.n_distinct for r in profile.dataset_overview(df).collect()}
    approx = {r.column_name: r.n_distinct for r in profile.dataset_overview(df, exact=False).collect()}
    assert exact["a"] == 5000 and abs(approx["a"] - 5000) / 5000 < 0.1 and approx["Anio"] == 1


def test_five_number_whiskers(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]  # q1 = 2, q3 = 4, upper fence 7: 100 is beyond it
    df = spark.createDataFrame([("g", v) for v in vals] + [("h", None)], "g string, v double")
    r = profile.five_number_by_group(df, "v", "g").collect()
    assert len(r) == 1
    r = r[0]
    assert (r.min, r.q1, r.median, r.q3, r.max) == (1.0, 2.0, 3.0, 4.0, 100.0)
    assert r.whisker_low == 1.0 and r.whisker_high == 4.0 and r.n == 5


def test_label_report_counts_unknowns(spark):
    from riskloom.functions.risk import label_report
    df = spark.createDataFrame([("Riesgo alto",), ("",), (None,), ("PÃ©rdida crÃ­tica",), ("nan",)], "nivel_riesgo string")
    r = label_report(df).first()
    assert (r.n_rows, r.n_unknown, r.n_clase_0, r.n_clase_3, r.n_clase_4) == (5, 3, 3, 1, 1)


def test_doubled_quotes_stay_in_their_field(spark, workdir):
    from riskloom.sources import files
    with open(f"{workdir}/q.csv", "w", encoding="latin-1") as f:
        f.write('Anio,Nomcultivo,Sembrada\n2020,"Maiz ""blanco"", grano",5\n')
    row = files.read_records(spark, f"{workdir}/q.csv").first()
    assert (row.Nomcultivo, row.Sembrada) == ('Maiz "blanco", grano', 5.0)
    files.export_clean(spark.createDataFrame([row]), f"{workdir}/out")
    assert files.read_records(spark, f"{workdir}/out").first().Nomcultivo == row.Nomcultivo


def test_texts_that_are_no_numbers_become_null(spark):
    from riskloom.operators.clean import apply_types
    df = spark.createDataFrame([("NaN", "9000000000"), ("Infinity", "2010.0"), ("-inf", "x"),
                                ("1.5", "NaN")], "Sembrada string, Idmunicipio string")
    got = apply_types(df, ["Sembrada"], integer=["Idmunicipio"]).collect()
    assert [r.Sembrada for r in got] == [None, None, None, 1.5]
    assert [r.Idmunicipio for r in got] == [9_000_000_000, 2010, None, None]


def test_top_crops_are_ranked_on_the_full_table(spark):
    from riskloom.operators.profile import top_crops_by_state
    rows = [("A", "x")] * 10 + [("B", "z")] * 9 + [("C", "z")] * 8
    df = spark.createDataFrame(rows, "Nomestado string, Nomcultivo string")
    assert [tuple(r) for r in top_crops_by_state(df, 1, 1).collect()] == [("A", "z", 0)]


def test_score_on_an_edge_belongs_to_the_lower_bin(spark):
    from riskloom.operators.metrics import calibration_curve
    df = spark.createDataFrame([(0, [0.0, 0.0, 0.0, 0.0, 0.2])] * 7
                               + [(4, [0.0, 0.0, 0.0, 0.0, 0.9])] * 3, "y int, p array<double>")
    got = {r.bin: r.n for r in calibration_curve(df, 4, 2).collect()}
    assert got == {0: 7, 1: 3}


def test_names_follow_the_ascending_loss_share(spark):
    from riskloom.operators.cluster import cluster_sizes
    df = spark.createDataFrame([(0,), (2,)], "cluster int")
    got = {r.cluster: r.nombre for r in cluster_sizes(df).collect()}
    assert got == {0: "Riego Comercial", 2: "Temporal Gran Escala"}


def test_caller_keeps_a_persisted_frame(spark):
    from pyspark.ml.linalg import Vectors
    from riskloom.operators.cluster import kmeans_fit
    df = spark.createDataFrame([(Vectors.dense([float(i % 3), 1.0]),) for i in range(30)],
                               ["scaled"]).persist()
    kmeans_fit(df, k=2, n_init=2)
    assert df.is_cached and df.storageLevel.useMemory
    df.unpersist()


def test_climate_join_by_cycle_name(spark):
    from riskloom.operators.joins import climate_left_join
    df = spark.createDataFrame(
        [(1, 2001, 5, "Otoño-Invierno"), (2, 2001, 5, " PRIMAVERA-VERANO "), (3, 2001, 5, "Otono-Invierno"),
         (4, 2001, 5, "siesta"), (5, 2001, 5, None)],
        "record_id long, Anio int, Idestado int, Nomcicloproductivo string")
    climate = spark.createDataFrame([(2001, 5, 1, 10.0), (2001, 5, 2, 20.0)],
                                    "Anio int, Idestado int, Idciclo int, clima_t double")
    got = {r.record_id: r.clima_t for r in climate_left_join(
        df, climate, cycle_name="Nomcicloproductivo", check_unique=True).collect()}
    assert got == {1: 20.0, 2: 10.0, 3: 20.0, 4: None, 5: None}
