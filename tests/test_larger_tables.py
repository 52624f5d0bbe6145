"""Queries on odd values and on tables larger than the given ones."""

from __future__ import annotations

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella import plans
from tessella.functions import statistics as st
from tessella.operators import adaptive as ad
from tessella.operators import joins, kernels
from tessella.streaming import machines, runner


def made_events(folder, rows: list[tuple]) -> str:
    """A folder with events (event_id, user_id, event_type, value) of its own."""
    frame = pd.DataFrame(rows, columns=["event_id", "user_id", "event_type", "value"])
    frame.astype({"event_id": "int64", "user_id": "int64", "value": "float64"}).to_parquet(f"{folder}/events.parquet", index=False)
    return str(folder)


def by_sql(folder: str, name: str) -> list[tuple]:
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return sorted(con.execute(plans.SQL[name]).fetchall())


def by_spark(spark, folder: str, name: str, *columns: str) -> list[tuple]:
    return sorted(map(tuple, plans.QUERIES[name](spark, folder).select(*columns).collect()))


def test_repetitions_with_a_median_of_zero(spark, tmp_path):
    """One of five repetitions has views of 0 ms; its ratio is infinite, the median is not."""
    rows = [(100 * k + j, 7, kind, v) for k in range(5) for j, (kind, v) in enumerate((("click", 2.0 + k), ("view", 0.0 if k == 3 else 2.5)))]
    d = made_events(tmp_path, rows)
    assert by_spark(spark, d, "paired_repetitions", "user_id", "pairs", "ratio", "gate") == by_sql(d, "paired_repetitions") == [(7, 5, 1600000, "INCONCLUSIVE")]


@pytest.mark.parametrize(("a", "b", "want"), [(1.0, 0.0, math.inf), (-1.0, 0.0, -math.inf), (0.0, 0.0, math.nan), (math.nan, 0.0, math.nan), (3.0, 2.0, 1.5), (None, 0.0, None), (1.0, None, None)])
def test_ratio(spark, a, b, want):
    found = spark.createDataFrame([(a, b)], "a double, b double").select(st.ratio(F.col("a"), F.col("b"))).first()[0]
    assert found is want is None or repr(found) == repr(want)


def test_running_variance_at_the_edge_of_two_results(spark, tmp_path):
    """The variance of these eleven values is a whole number of hundredths less 0.4, where the last bit decides."""
    values = [45.95, 56.4, 77.2, 19.98, 4.78, 4.77, 104.63, 35.24, 112.87, 41.22, 10.88]
    d = made_events(tmp_path, [(k, 7, "view", v) for k, v in enumerate(values)] + [(50, 8, "view", 3.0), (51, 8, "view", 5.0)])
    assert by_spark(spark, d, "running_moments", "idx", "n", "mean", "var_pop") == by_sql(d, "running_moments")


def test_running_moments_count_no_nulls(spark):
    rows = spark.createDataFrame([(None, 1, 4.0), (None, 2, 6.0), (1, 1, None), (1, 2, 3.0)], "k long, o long, v double")
    found = {(r["k"], r["o"]): (r["n"], r["mean"], r["var_pop"]) for r in st.running_moments(rows, "k", "o", "v").collect()}
    assert found == {(None, 1): (1, 4.0, 0.0), (None, 2): (2, 5.0, 1.0), (1, 1): (0, None, None), (1, 2): (1, 3.0, 0.0)}


def plain_frame(rows: list[tuple], cells: int, most: int) -> list[tuple]:
    """One frame, pair by pair."""
    at = lambda v: min(int(max(0.0, min(0.999999999, v)) * cells), cells - 1)
    out = []
    for i, x, y, vx, vy, m in rows:
        near = sorted((at(r[2]), at(r[1]), r[0], r) for r in rows if r[0] != i and abs(at(r[1]) - at(x)) <= 1 and abs(at(r[2]) - at(y)) <= 1)[:most]
        fx = fy = 0.0
        for *_, (_, ox, oy, _, _, om) in near:
            r = 1.0 / math.sqrt((ox - x) ** 2 + (oy - y) ** 2 + kernels.SOFT)
            fx, fy = fx + (ox - x) * r * (kernels.PULL * om * r * r), fy + (oy - y) * r * (kernels.PULL * om * r * r)
        moved = []
        for p, v, f in ((x, vx, fx), (y, vy, fy)):
            v = (v + f) * kernels.DAMPING
            p += v
            moved.append((-p if p < 0 else 2 - p, -v * kernels.BOUNCE) if not 0 <= p <= 1 else (p, v))
        out.append((i, moved[0][0], moved[1][0], moved[0][1], moved[1][1], m))
    return out


def test_crowded_cells_give_one_short_list(spark):
    """A cell's particles share one list of neighbours, and no pair of particles is shuffled."""
    rows = [(k, (k * 37 % 101) / 101, (k * 53 % 103) / 103, 0.01 * (k % 7 - 3), 0.01 * (k % 5 - 2), 1.0 + k % 3) for k in range(150)]
    frame = spark.createDataFrame(rows, "id long, x double, y double, vx double, vy double, mass double")
    placed = frame.withColumn("cx", F.floor(F.col("x") * 4)).withColumn("cy", F.floor(F.col("y") * 4))
    lists = kernels._first_neighbors(placed, 9).collect()
    assert len(lists) >= 16 and max(len(r["near"]) for r in lists) == 10
    found = sorted(map(tuple, kernels.simulate(frame, 4, 2, 9).collect()))
    for got, want in zip(found, plain_frame(plain_frame(rows, 4, 9), 4, 9), strict=True):
        assert got == pytest.approx(want, rel=1e-12, abs=1e-15)


def test_many_points_ask_finer_cells_first(spark, monkeypatch):
    """The nearest of all, with ties, copies, a sparse corner and a crowd; few points are left for pairs within the whole radius."""
    at = [((k * 37 % 101) / 101, (k * 53 % 103) / 103) for k in range(2500)] + [(0.5 + (k % 20) / 4000, 0.5 + (k // 20) / 4000) for k in range(400)] + [(0.25, 0.75)] * 30
    at = [(x, y) for x, y in at if not (x < 0.25 and y < 0.25)] + [(0.1, 0.1), (0.12, 0.1), (0.0, 0.0), (1.0, 1.0)]
    rows = [(k, *p) for k, p in enumerate(at)]
    left, within = [], joins._all_within

    def seen(asking, *a):
        left.append(asking.count())
        return within(asking, *a)

    monkeypatch.setattr(joins, "_all_within", seen)
    found = {}
    for r in joins.grid_neighbors(spark.createDataFrame(rows, "id long, x double, y double"), 4, 0.2, 5).collect():
        found.setdefault(r["id"], []).append((r["d2"], r["other"]))
    assert left[0] < len(rows) / 50
    for i, x, y in rows:
        want = sorted((d2, o) for o, ox, oy in rows if o != i and (d2 := (x - ox) * (x - ox) + (y - oy) * (y - oy)) <= 0.2 * 0.2)[:5]
        assert sorted(found.get(i, [])) == want


class PlainQueue(list):
    """Waiting requests, looked through each time."""

    add = list.append
    head = lambda self: self[0]
    all = list.copy

    def of(self, identifier: int) -> list[dict]:
        return [r for r in self if r["id"] == identifier]

    def first_fit(self, free: int) -> dict | None:
        return next((r for r in self if (r["requested"] if r["exact"] else r["minimum"]) <= free), None)

    def expired(self, now: int) -> list[dict]:
        return [r for r in self if r["policy"] == "deadline" and now >= r["deadline"]]


def test_indexed_queue_answers_as_a_list_does():
    import random

    for seed in range(20):
        draw, governors = random.Random(seed), [machines.Governor(6), machines.Governor(6)]
        governors[1].waiting = PlainQueue()
        for ms in range(600):
            op = draw.choices(["acquire", "release", "cancel", "shutdown"], [60, 30, 10, 0.1])[0]
            least = draw.randint(0, 7)
            exact = draw.random() < 0.4
            # identifiers are never used twice, but a cancel or a release may name any
            e = {"op": op, "id": ms if op == "acquire" else draw.randrange(ms + 1), "ms": ms, "requested": least if exact else least + draw.randint(0, 3), "minimum": least, "exact": exact, "policy": draw.choice(["wait", "fail", "deadline"]), "deadline": ms + draw.randint(-1, 80)}
            assert governors[0].step(dict(e)) == governors[1].step(dict(e))


def test_long_queues_are_not_looked_through():
    """A queue of 60,000 requests behind a full budget: a minute and more if each event looks at all."""
    import time

    g, began = machines.Governor(8), time.process_time()
    for ms in range(60_000):
        out = g.step({"op": "acquire", "id": ms, "ms": ms, "requested": 8, "minimum": 8, "exact": True, "policy": "wait" if ms % 2 else "deadline", "deadline": 10**9})
        assert time.process_time() - began < 30
    assert (out["queued"], out["grants"], out["oldest_ms"]) == (59_999, 1, 59_998)


def test_fold_gives_the_last_row_of_a_key(spark):
    class Sum:
        total = 0

        def step(self, e: dict) -> dict:
            self.total += e["v"]
            return {"total": self.total}

    rows = spark.createDataFrame([(k if k else None, o, o) for k in range(3) for o in range(k + 2)], "k long, o long, v long")
    every, last = (runner.fold(rows, "k", "o", Sum, lambda e: e, "total long", last=x).collect() for x in (False, True))
    assert sorted((r["k"] or 0, r["o"], r["total"]) for r in last) == [(0, 1, 1), (1, 2, 3), (2, 3, 6)]
    assert len(every) == 9 and set(last) <= set(every)


def made_prints(spark, n: int, different: int):
    """Fingerprints of ``n`` workloads with few different ones, with zeros, nulls and workloads without a name or kind."""
    of = lambda k: [k % 2, 2 ** (k % 7), 2 ** (k % 5) if k % 4 else 0, 8, (2050 + k % 3 << 4) + k % 16 if k % 5 else 0, (2049 << 4) + 8 if k % 3 else None, k % 4, 64 * (k % 3), (2049 << 4) + k % 7, 1 + k % 2, k % 3 if k % 7 else None]
    rows = [(k, *of(k % different)) for k in range(n)] + [(None, *of(3)), (n, None, *of(3)[1:]), (n + 1, 7, *[None] * 10)]
    return spark.createDataFrame(rows, "w long, " + ", ".join(f"{b} long" for b in ad.BUCKETS))


def plain_pairs(left, right):
    a = left.select("w", *[F.col(b).alias(f"a_{b}") for b in ad.BUCKETS])
    b = right.select(F.col("w").alias("other"), *[F.col(b).alias(f"b_{b}") for b in ad.BUCKETS])
    return ad.similarity_chain().apply(a.join(b, F.col("a_kind") == F.col("b_kind"))).select("w", "other", "similarity", "coverage")


def test_equal_fingerprints_are_compared_once(spark, monkeypatch):
    """Every pair and the same values bit by bit, from few comparisons in many tasks."""
    monkeypatch.setattr(ad, "CELL", 4)
    compared, similar_rows = [], ad.similar_rows

    def seen(left, right):
        found = similar_rows(left, right)
        compared.append((found.count(), found.rdd.getNumPartitions()))
        return found

    monkeypatch.setattr(ad, "similar_rows", seen)
    order = lambda df: sorted(map(tuple, df.collect()), key=repr)
    some, others = made_prints(spark, 160, 8), made_prints(spark, 45, 11).where("w is null or w > 4")
    assert order(ad.similar_pairs(some, some, "w")) == order(plain_pairs(some, some))
    assert order(ad.similar_pairs(some, others, "w")) == order(plain_pairs(some, others))
    assert compared[0][0] < 161 * 161 / 100 and compared[0][1] >= 16


def test_neighbors_weigh_sums_of_equal_fingerprints(spark, monkeypatch):
    """The means of every pair with an entry, though fingerprints are compared once; a vast or infinite own entry leaves no trace in its own mean."""
    monkeypatch.setattr(ad, "CELL", 4)
    compared = []

    def seen(left, right):
        found = ad.similar_rows(left, right)
        compared.append(found.count())
        return found

    monkeypatch.setattr(joins, "similar_rows", seen)
    prints = made_prints(spark, 160, 8)
    vast = {8: 1e300, 17: math.inf, 26: None}
    of = lambda k: (k, vast.get(k, 1.0 + k % 9), float(k % 5), (k % 4) / 3.0, None if k % 13 == 0 else (k % 11) / 11.0, 0.5 + k % 6, k % 10)
    rows = [of(k) for k in range(160) if k % 8 != 5] + [(k, 2.0, 1.0, 0.5, 0.5, 3.0, 2) for k in (3, 21, None)] + [(5, 4.0, 1.0, 1.0, 0.9, 2.0, 1)]  # the sixth fingerprint has one entry, and some workloads have two
    entries = spark.createDataFrame(rows, "other long, elapsed_ms double, regret_percent double, success_rate double, confidence double, sample_weight double, samples long")
    means = ("elapsed_ms", "regret_percent", "success_rate", "confidence", "similarity")
    for least in (0.55, 0.97):
        found = {r["w"]: r for r in joins.weighted_neighbors(prints, entries, "w", least).collect()}
        want: dict[int, list] = {}
        known = [r.asDict() for r in entries.where("samples > 0").collect()]
        for p in plain_pairs(prints, prints).where((F.col("similarity") >= least) & (F.col("w") != F.col("other"))).collect():
            for e in known:
                if e["other"] == p["other"]:
                    confidence = 0.01 if e["confidence"] is None else max(0.01, e["confidence"])
                    want.setdefault(p["w"], []).append((p["similarity"] ** 2 * confidence * max(1.0, e["sample_weight"]), e | {"similarity": p["similarity"]}))
        assert found.keys() == want.keys()
        for w, used in want.items():
            assert found[w]["entries"] == len(used)
            for c in means:
                assert found[w][c] == pytest.approx(sum(k * e[c] for k, e in used if e[c] is not None) / sum(k for k, _ in used), rel=1e-12, nan_ok=True)
    assert max(compared) <= 11 * 11
