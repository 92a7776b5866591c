import datetime
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablescope.functions.types import lanes
from tablescope.operators import profile, signals
from tablescope.operators.quantiles import column_quantiles, weighted_quantiles

NAN = float("nan")
DAY = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    mixed = spark.createDataFrame(
        [
            (1, 0.0, "a", None, DAY, True, b"\xff", [1], datetime.date(2024, 1, 1)),
            (1, -0.0, "", None, DAY, False, b"\xff", [1], datetime.date(2024, 1, 1)),
            (2, NAN, "a", None, DAY, True, b"\xfe", [2], None),
            (None, NAN, " ", None, None, True, None, None, None),
        ],
        "k bigint, x double, s string, e string, t timestamp_ntz, b boolean, r binary, l array<int>, d date",
    )
    empty = spark.createDataFrame([], "k bigint, s string")
    return {"c.s.mixed": mixed, "c.s.empty": empty}


def test_profile_counts_values_of_every_type(tables):
    found = {(r.table_name, r.column_name): r for r in profile.data_profile(tables).collect()}
    distinct = {c: found["mixed", c].distinct_count for c in "kxsetbrld"}
    assert distinct == {"k": 2, "x": 2, "s": 3, "e": 0, "t": 1, "b": 2, "r": 2, "l": 2, "d": 1}
    assert found["mixed", "k"].null_ratio == 0.25 and found["mixed", "k"].uniqueness_ratio == 0.5
    assert found["mixed", "e"].null_ratio == 1.0 and found["mixed", "e"].row_count == 4
    assert found["mixed", "k"].data_type == "LONG" and found["mixed", "t"].data_type == "TIMESTAMP"


def test_empty_table_has_null_ratios(tables):
    found = {r.column_name: r for r in profile.data_profile(tables).filter("table_name = 'empty'").collect()}
    assert found["k"].row_count == 0 and found["k"].distinct_count == 0
    assert found["k"].null_ratio is None and found["s"].uniqueness_ratio is None


def test_quality_stats(tables):
    found = {r.column_name: r for r in profile.quality_stats(tables).filter("table_name = 'mixed'").collect()}
    assert found["x"].zero_count == 2 and found["k"].zero_count == 0 and found["s"].zero_count is None
    assert found["k"].null_percentage == 25.0 and found["k"].total_rows == 4


def test_fingerprint_ignores_row_order_and_partitions(spark, tables):
    mixed = tables["c.s.mixed"]
    other = mixed.orderBy(F.desc("k")).repartition(3)
    changed = mixed.withColumn("s", F.concat("s", F.lit("!")))

    def prints(df):
        return {r.column_name: r.fingerprint for r in profile.quality_stats({"c.s.mixed": df}).collect()}

    assert prints(mixed) == prints(other)
    assert prints(mixed)["s"] != prints(changed)["s"] and prints(mixed)["k"] == prints(changed)["k"]


def test_distribution(spark):
    values = [1.0, 2.0, 2.0, 10.0, None]
    df = spark.createDataFrame([(v, "x") for v in values], "v double, s string")
    row = profile.distribution_stats({"c.s.t": df}).first()
    assert (row.column_name, row.row_count, row.distinct_count) == ("v", 5, 3)
    assert (row["mean"], row.min_val, row.p25, row["median"], row.p75, row.max_val) == (3.75, 1, 1.75, 2, 4, 10)


@pytest.mark.parametrize("parts", [None, 1, 7])
def test_quantiles_match_numpy(spark, parts):
    rng = random.Random(4)
    data = {k: [round(rng.gauss(0, 9), 1) for _ in range(n)] for k, n in (("a", 400), ("b", 1), ("c", 2), ("d", 75))}
    data["hot"] = [5.0] * 300 + [7.0]
    frame = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, value double")
    counted = frame.groupBy("k", "value").agg(F.count(F.lit(1)).alias("n"))
    points = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = {
        (r.k, r.quantile): r.value for r in weighted_quantiles(counted, ["k"], points, parts).collect()
    }
    assert len(found) == len(data) * len(points)
    for (k, q), value in found.items():
        assert value == pytest.approx(np.quantile(data[k], q)), (k, q)


def test_quantiles_without_keys(spark):
    counted = spark.createDataFrame([(1.0, 3), (4.0, 1)], "value double, n bigint")
    for parts in (None, 1, 2):
        found = weighted_quantiles(counted, [], [0.5, 1.0], parts)
        assert {r.quantile: r.value for r in found.collect()} == {0.5: 1.0, 1.0: 4.0}


@pytest.mark.parametrize("size", [8, 200])
def test_column_quantiles_match_numpy(spark, size):
    """A sketch of eight misses its ranks, so brackets are opened; the results stay exact."""
    rng = random.Random(size)
    rows = [
        (
            i,
            rng.gauss(0, 1) if i % 7 else None,
            5.0 if i % 3 else float(i),
            math.nan if i % 4 == 0 else rng.choice([-math.inf, 0.5, 2.5]),
            None,
            math.nan,
        )
        for i in range(3000)
    ]
    wide = spark.createDataFrame(rows, "a int, b double, hot double, c double, nulls double, nans double")
    one = spark.createDataFrame([(7,)], "only int").selectExpr("cast(only as decimal(30,2)) AS only")
    tables = {"c.s.wide": wide.repartition(5), "c.s.one": one, "c.s.empty": wide.limit(0), "c.s.bare": one.drop("only")}
    points = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    found = {
        (r.full_name, r.ordinal_position, r.quantile): r.value
        for r in column_quantiles(tables, points, size).collect()
    }
    expected = {("c.s.one", 1, q): 7.0 for q in points}
    for place in (1, 2, 3, 4, 6):
        values = sorted((r[place - 1] for r in rows if r[place - 1] is not None), key=lambda v: (v != v, v))
        for q in points:
            at = (len(values) - 1) * q
            low, high = values[math.floor(at)], values[math.ceil(at)]
            expected["c.s.wide", place, q] = low + (high - low) * (at - math.floor(at)) if low != high else low
    assert found.keys() == expected.keys()
    for key, value in expected.items():
        assert found[key] == pytest.approx(value, nan_ok=True), key


def test_column_quantiles_of_nothing(spark):
    assert column_quantiles({}, [0.5]).count() == 0
    assert column_quantiles({"c.s.t": spark.createDataFrame([(1,)], "v int")}, []).count() == 0


def test_files_and_freshness(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).repartition(3).write.parquet(path)
    row = profile.file_sizes({"c.s.t": path}).first()
    sizes = [f.stat().st_size for f in (tmp_path / "t").glob("*.parquet")]
    assert (row.file_size_bytes, row.file_count) == (sum(sizes), len(sizes))
    stats = profile.distribution_stats({"c.s.t": spark.read.parquet(path)}, {"c.s.t": path}).first()
    assert stats.file_size_bytes == sum(sizes)
    fresh = profile.file_freshness({"c.s.t": path}, F.current_timestamp(), {"c.s.t": 3}).first()
    assert 0 <= fresh.latency_hours < 1 and (fresh.partition_count, fresh.current_version) == (1, 3)
    seen = [("t", DAY + datetime.timedelta(hours=h), h // 10, h % 2) for h in (1, 5, 30)]
    frame = spark.createDataFrame(seen, "table string, at timestamp_ntz, part int, version int")
    as_of = F.lit(DAY + datetime.timedelta(hours=42)).cast("timestamp_ntz")
    row = profile.freshness_stats(frame, ["table"], F.col("at"), as_of, F.col("part"), F.col("version")).first()
    assert row.latency_hours == 12 and row.partition_count == 2 and row.current_version == 2
    assert row.last_documented_at is None


def history(spark):
    shape = [("a", 0, 10, "h1"), ("a", 30, 12, "h1"), ("a", 31, 12, "h2"), ("b", 5, 0, "h1")]
    data = [(k, DAY + datetime.timedelta(hours=h), n, s) for k, h, n, s in shape]
    return spark.createDataFrame(data, "full_table_name string, at timestamp_ntz, row_count bigint, schema_hash string")


def test_validity_and_drift(spark):
    found = signals.validity(history(spark), ["full_table_name"], "at").orderBy("full_table_name", "at").collect()
    hour = lambda h: DAY + datetime.timedelta(hours=h)
    assert [(r.valid_from, r.valid_to, r.is_current) for r in found] == [
        (hour(0), hour(30), False), (hour(30), hour(31), False), (hour(31), None, True), (hour(5), None, True),
    ]
    changes = signals.drift(history(spark), ["full_table_name"], "at").orderBy("full_table_name", "at").collect()
    assert [(r.row_count_change, r.schema_changed) for r in changes] == [
        (None, False), (2, False), (0, True), (None, False),
    ]


def test_rows_with_null_keys_have_a_history_too(spark):
    data = [(None, 1), (None, 3), ("a", 2), ("a", 4)]
    frame = spark.createDataFrame([(k, DAY + datetime.timedelta(hours=h)) for k, h in data], "k string, at timestamp_ntz")
    found = {(r.k, r.at): r.valid_to for r in signals.validity(frame, ["k"], "at").collect()}
    hour = lambda h: DAY + datetime.timedelta(hours=h)
    assert found == {(None, hour(1)): hour(3), (None, hour(3)): None, ("a", hour(2)): hour(4), ("a", hour(4)): None}


def test_extremes_are_found_in_the_type_of_the_column(spark):
    df = spark.sql(
        """SELECT * FROM VALUES (9.50BD, TIMESTAMP '2024-01-02 00:00:00', true, DATE '2024-01-02', X'0A', array(2, 10), 9L, 'b'),
        (10.00BD, TIMESTAMP '2023-01-02 10:00:00', false, DATE '2024-01-01', X'FF', array(10), 10L, 'a'),
        (NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL) AS t(d, ts, b, day, bin, arr, n, s)"""
    ).withColumn("nothing", F.lit(None).cast("int"))
    found = {r.column_name: (r.min_value, r.max_value) for r in signals.column_signals({"c.s.t": df}, F.lit(DAY)).collect()}
    assert found == {
        "d": ("9.50", "10.00"),
        "ts": ("2023-01-02 10:00:00", "2024-01-02 00:00:00"),
        "b": ("false", "true"),
        "day": ("2024-01-01", "2024-01-02"),
        "bin": ("0A", "FF"),
        "arr": ("[2,10]", "[10]"),
        "n": ("9", "10"),
        "s": ("a", "b"),
        "nothing": (None, None),
    }


def test_neighbours_across_ranges_match_a_window(spark):
    rng = random.Random(6)
    data = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(9)}", i) for i in rng.sample(range(9000), 600)]
    frame = spark.createDataFrame(
        [(k, DAY + datetime.timedelta(minutes=i), i) for k, i in data], "k string, at timestamp_ntz, i int"
    ).repartition(5)
    found = signals.with_neighbour(frame, ["k"], "at", ["i"], "prior", earlier=True)
    by_key = {}
    for k, i in sorted(data, key=lambda x: x[1]):
        by_key.setdefault(k, []).append(i)
    expected = {(k, i): (None if n == 0 else line[n - 1]) for k, line in by_key.items() for n, i in enumerate(line)}
    assert {(r.k, r.i): (r.prior.i if r.prior else None) for r in found.collect()} == expected


def test_current_signal_and_health(spark):
    data = [
        ("a", DAY, True, 0, 0.0), ("a", DAY + datetime.timedelta(days=1), False, 5, 0.0),
        ("b", DAY, False, 5, 0.0), ("b", DAY + datetime.timedelta(days=2), None, 7, 0.0),
        ("c", None, None, 7, 0.0), ("d", DAY + datetime.timedelta(days=2), True, 7, 0.1),
    ]
    frame = spark.createDataFrame(
        data, "full_table_name string, freshness_timestamp timestamp_ntz, is_current boolean, row_count int, null_ratio double"
    )
    current = signals.current_signal(frame)
    assert rows(current, "full_table_name", "row_count") == [("a", 0), ("b", 7), ("c", 7), ("d", 7)]
    as_of = F.lit(DAY + datetime.timedelta(days=3)).cast("timestamp_ntz")
    states = current.select("full_table_name", signals.health_status(as_of).alias("status"))
    # Exactly a day old is not yet old; a missing time is.
    assert rows(states) == [("a", "critical"), ("b", "healthy"), ("c", "warning"), ("d", "warning")]


def test_bands(spark):
    frame = spark.createDataFrame([(0.0, 0.88), (0.05, 0.7), (0.1, 0.69)], "null_ratio double, confidence double")
    found = frame.select(signals.null_band(), signals.confidence_band()).collect()
    assert [tuple(r) for r in found] == [("none", "High"), ("some", "Med"), ("many", "Low")]


def test_signals_of_tables(spark, tables):
    at = F.lit(DAY).cast("timestamp_ntz")
    found = {r.table_name: r for r in signals.table_signals(tables, at).collect()}
    assert found["mixed"].column_count == 9 and found["mixed"].row_count == 4 and found["empty"].row_count == 0
    assert found["mixed"].schema_hash != found["empty"].schema_hash
    ends = {r.column_name: (r.min_value, r.max_value) for r in signals.column_signals(tables, at).collect() if r.table_name == "mixed"}
    assert ends["k"] == ("1", "2") and ends["s"] == ("", "a") and ends["e"] == (None, None)


def test_lookups(spark, tables):
    stats = profile.quality_stats(tables)
    found = signals.quality_of(stats, "`c`.s.mixed").collect()
    assert [r.column_name for r in found] == sorted("kxsetbrld")
    with pytest.raises(ValueError):
        signals.quality_of(stats, "s.mixed")
    with pytest.raises(ValueError):
        signals.sort_column_signals(stats, "nothing")


def test_clean_scalars(spark):
    from tablescope.functions.types import clean_scalars

    day = datetime.datetime(2024, 1, 2, 3, 4, 5)
    schema = "x double, f float, at timestamp_ntz, day date, s string, n int"
    data = [(float("nan"), float("nan"), day, day.date(), "a", 1), (1.5, 2.0, day.replace(microsecond=120), None, None, None)]
    assert [tuple(r) for r in clean_scalars(spark.createDataFrame(data, schema)).collect()] == [
        (None, None, "2024-01-02T03:04:05", "2024-01-02", "a", 1),
        (1.5, 2.0, "2024-01-02T03:04:05.000120", None, None, None),
    ]


def test_fingerprints_of_every_type_are_sums_over_rows(spark, tables):
    """Fingerprints are added up from distinct values; -0.0 and long texts keep their own digests."""
    long_text = "x" * 40
    words = spark.createDataFrame([(w,) for w in ["", "a", "a", long_text, long_text, "fifteen bytes..", "sixteen bytes..."] + [None]], "w string")
    with_words = tables | {"c.s.words": words}
    found = {(r.table_name, r.column_name): r.fingerprint for r in profile.quality_stats(with_words).collect()}

    def plain(df, column):
        field = df.schema[column]
        text = F.coalesce(*(lane.cast("string") for lane in lanes(field)))
        return [None if r[0] is None else int(hashlib.md5(r[0].encode()).hexdigest()[:15], 16) for r in df.select(text).collect()]

    for name, df in with_words.items():
        for column in df.columns:
            bits = [b for b in plain(df, column) if b is not None]
            assert found[name.split(".")[2], column] == (str(sum(bits)) if bits else None), (name, column)


def test_texts_are_digested_once_per_value_and_keys_are_narrow(spark):
    """Rows on their way to the counts are a column's number and one value."""
    df = spark.createDataFrame([(1, "a")], "k bigint, s string")
    plan = profile.distinct_counts({"c.s.t": df}, bits=True)._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in plan.splitlines() if "Aggregate [place" in line]
    assert grouped and all("full_name" not in line for line in grouped)
    assert profile.distinct_counts({}).collect() == []
