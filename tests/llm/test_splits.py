import random
from collections import defaultdict

from pyspark.sql import functions as F

import pytest

from sparquill.llm.splits import assign_splits, log_records, normal_id, query_links, spanning_forest, split_report, split_rows, star_edges
from sparquill.operators import balance

LOG = "id long, query_id string, sql_text string, root string"
SHARES = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        parent[find(u)] = find(v)
    out = defaultdict(set)
    for x in parent:
        out[find(x)].add(x)
    return {frozenset(c) for c in out.values()}


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_forest_spans_and_has_no_cycle(spark, monkeypatch, broadcast):
    monkeypatch.setattr(balance, "BROADCAST_ROWS", broadcast)
    rng = random.Random(3)
    edges = [(f"n{a}", f"n{b}", rng.randrange(3)) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(70)) if a != b]
    edges += [(f"c{i}", f"c{i + 1}", 1) for i in range(40)]
    forest, labels = spanning_forest(spark.createDataFrame(edges, "u string, v string, w int"))
    want = components((u, v) for u, v, _ in edges)
    got = defaultdict(set)
    for r in labels.collect():
        got[r["root"]].add(r["node"])
    assert {frozenset(c) for c in got.values()} == want
    chosen = forest.collect()
    assert len(chosen) == sum(len(c) - 1 for c in want)
    assert components((r["u"], r["v"]) for r in chosen) == want
    weights = sorted(w for _, _, w in edges)
    assert sum(r["w"] for r in chosen) <= sum(weights[-len(chosen) :])


def test_no_edges(spark):
    forest, labels = spanning_forest(spark.createDataFrame([], "u string, v string, w int"))
    assert forest.count() == 0 and labels.count() == 0
    loops = spark.createDataFrame([("a", "a", 0)], "u string, v string, w int")
    assert [t.count() for t in spanning_forest(loops)] == [0, 0]


def test_spellings(spark):
    same = ["mk_2w_07", "MK-2W-07", " mk.2w 07\t", "Mk_2w-07"]
    df = spark.createDataFrame([(s,) for s in [*same, "user:mk_2w_07", "mk_2w_08", "mk2w07"]], "q string")
    keys = [r[0] for r in df.select(normal_id(F.col("q"))).collect()]
    assert len(set(keys[:4])) == 1 and len(set(keys)) == 4
    assert spark.createDataFrame([("user:Maker-review 1 ",), ("user:maker_review_1",)], "q string").select(normal_id(F.col("q"))).distinct().count() == 1


def test_star_edges_are_linear(spark):
    pairs = spark.createDataFrame([(f"m{i % 50}", "hub") for i in range(500)] + [("x", None), (None, "hub")], "member string, hub string")
    assert star_edges(pairs, 0).count() == 49


def rows(spark):
    data = [(1, "a_1", "select 1", "r"), (2, "A-1", "select 2", "r"), (3, "b", "SELECT 2;", "r"), (4, "c", "select 3", "r"), (5, None, "select 3", "r"), (6, None, "select 4", "r"), (7, None, "(select 4)", "r"), (8, "d", None, "r"), (9, None, None, "r"), (10, "", "select 9", "r"), (10, "", "select 9", "r")]
    return spark.createDataFrame(data, LOG)


def test_chains_and_nulls(spark):
    _, labels = spanning_forest(query_links(log_records(rows(spark))))
    assert {(r["node"], r["root"]) for r in labels.collect()} == {(n, "A-1") for n in ("A-1", "a_1", "b")}


def test_rows_of_one_query_stay_together(spark):
    out = split_rows(rows(spark), SHARES).collect()
    got = {r["id"]: (r["root"], r["split"]) for r in out}
    assert len(out) == 11
    assert set(got) == set(range(1, 11))
    assert len({got[i] for i in (1, 2, 3)}) == 1 and got[4] == got[5] and got[6] == got[7]
    assert len({got[i][0] for i in (1, 4, 6, 8, 9, 10)}) == 6
    assert split_rows(rows(spark).limit(0), SHARES).count() == 0


def sized(spark, groups):
    return spark.createDataFrame([(f"g{i}", n) for i, n in enumerate(groups)], "root string, n_rows long")


@pytest.mark.parametrize(
    "groups,off",
    [
        ([9000] + [1 + i % 5 for i in range(3000)], 0.003),
        ([4000, 1200, 1100, 900, 700, 600, 500] + [1 + i % 40 for i in range(500)], 0.01),
        ([1000 // k for k in range(1, 1000)], 0.005),
        ([100, 100, 100, 100, 100, 100, 100, 100, 100, 100], 0.11),
    ],
)
def test_shares_are_met_despite_large_groups(spark, groups, off):
    out = assign_splits(sized(spark, groups), SHARES)
    assert out.count() == len(groups) and out.agg(F.sum("n_rows")).first()[0] == sum(groups)
    total = {r["split"]: r["n"] for r in out.groupBy("split").agg(F.sum("n_rows").alias("n")).collect()}
    for name, share in SHARES:
        assert abs(total.get(name, 0) / sum(groups) - share) <= off
    assert out.exceptAll(assign_splits(sized(spark, groups), SHARES)).count() == 0


def test_no_split_gets_a_group_it_has_no_room_for(spark):
    out = assign_splits(sized(spark, [500, 300] + [1] * 200), SHARES).where("n_rows > 1").collect()
    assert {r["split"] for r in out} == {"train"}


def test_planted_groups_come_out_whole_and_in_proportion(spark):
    rng = random.Random(8)
    data, group = [], 0
    while len(data) < 4000:
        size = rng.choice([1, 2, 5, 20, 90]) if data else 900
        for k in range(size):
            name = f"q {group}".upper() if k % 2 else f" q_{group} "
            data.append((len(data), name if k % 7 else f"alias{group}_{k % 3}", f"select {group} from t", str(group)))
        group += 1
    log = spark.createDataFrame(data, LOG)
    out = split_rows(log, SHARES)
    joined = out.join(log.select("id", F.col("root").alias("planted")), "id").groupBy("planted").agg(F.count_distinct("split").alias("splits"), F.count_distinct(out["root"]).alias("roots"))
    assert joined.where("splits > 1 or roots > 1").count() == 0 and out.count() == len(data)
    report = {r["split"]: r for r in split_report(out, SHARES).collect()}
    assert all(abs(report[s]["reached_share"] - share) < 0.01 for s, share in SHARES)
    assert sum(r["n_groups"] for r in report.values()) == group
