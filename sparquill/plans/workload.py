"""Workloads of join queries: written ones, and ones made from a schema and its values."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparquill.operators.quantiles import group_percentiles, value_counts
from sparquill.plans.catalog import NUMERIC, TEMPORAL, TEXT, SchemaGraph


def join_queries(database: str) -> dict[str, str]:
    """Written queries of two to seven relations: with correlated filters, and controls."""
    t = f"{database}." if database else ""
    ocn = f"FROM {t}orders o JOIN {t}customer c ON o.o_custkey = c.c_custkey JOIN {t}nation n ON c.c_nationkey = n.n_nationkey"
    lo = f"FROM {t}lineitem l JOIN {t}orders o ON l.l_orderkey = o.o_orderkey JOIN {t}customer c ON o.o_custkey = c.c_custkey"
    return {
        "spj_2way_control": f"SELECT o.o_orderkey, o.o_totalprice, c.c_name FROM {t}orders o JOIN {t}customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'",
        "spj_2way_trap": f"SELECT n.n_name, r.r_name FROM {t}nation n JOIN {t}region r ON n.n_regionkey = r.r_regionkey WHERE n.n_name = 'NATION_7' AND r.r_name = 'ASIA'",
        "spj_3way": f"SELECT o.o_orderkey, c.c_name, n.n_name {ocn} WHERE n.n_name = 'NATION_7' AND o.o_totalprice > 100000.0",
        "spj_4way_trap": f"SELECT o.o_orderkey, c.c_name, n.n_name {ocn} JOIN {t}region r ON n.n_regionkey = r.r_regionkey WHERE n.n_name = 'NATION_7' AND r.r_name = 'ASIA'",
        "spj_5way": f"SELECT l.l_orderkey, l.l_linenumber, c.c_name, n.n_name {lo} JOIN {t}nation n ON c.c_nationkey = n.n_nationkey JOIN {t}region r ON n.n_regionkey = r.r_regionkey WHERE n.n_name = 'NATION_7' AND r.r_name = 'ASIA' AND l.l_quantity < 10.0",
        "spj_6way_trap": f"SELECT l.l_orderkey, l.l_linenumber, p.p_name, c.c_name {lo} JOIN {t}part p ON l.l_partkey = p.p_partkey JOIN {t}nation n ON c.c_nationkey = n.n_nationkey JOIN {t}region r ON n.n_regionkey = r.r_regionkey WHERE n.n_name = 'NATION_7' AND r.r_name = 'ASIA' AND p.p_size >= 10 AND p.p_size <= 20",
        "spj_7way": f"SELECT l.l_orderkey, l.l_linenumber, p.p_name, s.s_name {lo} JOIN {t}part p ON l.l_partkey = p.p_partkey JOIN {t}supplier s ON l.l_suppkey = s.s_suppkey JOIN {t}nation n ON s.s_nationkey = n.n_nationkey JOIN {t}region r ON n.n_regionkey = r.r_regionkey WHERE n.n_name = 'NATION_7' AND r.r_name = 'ASIA' AND p.p_brand = 'Brand#2'",
        "spj_self_join": f"SELECT a.s_name AS first_name, b.s_name AS second_name FROM {t}supplier a JOIN {t}supplier b ON a.s_nationkey = b.s_nationkey JOIN {t}nation n ON a.s_nationkey = n.n_nationkey WHERE n.n_name = 'NATION_7' AND a.s_acctbal > b.s_acctbal",
        "spj_interval": f"SELECT o.o_orderkey, c.c_name FROM {t}orders o JOIN {t}customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderdate > TIMESTAMP '1998-01-01 00:00:00' - INTERVAL '30' DAY AND c.c_acctbal IS NOT NULL AND c.c_mktsegment <> 'BUILDING'",
    } | _shop_queries(t) | _correlated_queries(t)


def _shop_queries(t: str) -> dict[str, str]:
    """Queries over a shop's products and suppliers: brand goes with category and price band."""
    pps = f"FROM {t}products p JOIN {t}product_suppliers ps ON ps.product_id = p.id"
    three = f"{pps} JOIN {t}suppliers s ON ps.supplier_id = s.id"
    return {
        "spj_shop_2way_brand_category": f"SELECT p.id, p.name, ps.lead_days {pps} WHERE p.brand = 'Orrivane' AND p.category = 'gadgets'",
        "spj_shop_2way_brand_band": f"SELECT p.id, ps.supplier_id {pps} WHERE p.brand = 'Cobalite' AND p.price_band = 'low'",
        "spj_shop_2way_band_price": f"SELECT p.id, ps.id AS link_id {pps} WHERE p.price_band = 'upper' AND p.price > 500.0",
        "spj_shop_3way_everything": f"SELECT p.name, s.name AS supplier_name {three} WHERE p.brand = 'Orrivane' AND p.category = 'gadgets' AND p.price_band = 'upper' AND s.rating >= 3",
        "spj_shop_3way_in_list": f"SELECT p.id, s.country {three} WHERE p.category IN ('gadgets', 'tools') AND s.rating BETWEEN 2 AND 4 AND ps.lead_days > 0",
        "spj_shop_2way_lead_control": f"SELECT ps.id, s.name FROM {t}product_suppliers ps JOIN {t}suppliers s ON ps.supplier_id = s.id WHERE ps.lead_days < 10",
        "spj_shop_3way_control": f"SELECT p.id, s.id AS supplier_no {three} WHERE ps.lead_days >= 20",
    }


def _correlated_queries(t: str) -> dict[str, str]:
    """Conditions that go together or exclude each other over the star schema, and controls."""
    oc = f"FROM {t}orders o JOIN {t}customer c ON o.o_custkey = c.c_custkey"
    lo = f"FROM {t}lineitem l JOIN {t}orders o ON l.l_orderkey = o.o_orderkey"
    ln = f"{lo} JOIN {t}customer c ON o.o_custkey = c.c_custkey JOIN {t}nation n ON c.c_nationkey = n.n_nationkey"
    return {
        "spj_2way_price_quantity": f"SELECT l.l_orderkey, l.l_linenumber, p.p_name FROM {t}lineitem l JOIN {t}part p ON l.l_partkey = p.p_partkey WHERE l.l_extendedprice > 60000.0 AND l.l_quantity > 40.0",
        "spj_2way_flag_status": f"SELECT l.l_orderkey, o.o_orderpriority {lo} WHERE l.l_returnflag = 'A' AND l.l_linestatus = 'F' AND o.o_orderstatus = 'F'",
        "spj_2way_date_status": f"SELECT o.o_orderkey, c.c_name {oc} WHERE o.o_orderdate < TIMESTAMP '1995-01-01 00:00:00' AND o.o_orderstatus = 'F' AND c.c_acctbal > 5000.0",
        "spj_3way_ship_order_dates": f"SELECT l.l_orderkey, c.c_mktsegment {lo} JOIN {t}customer c ON o.o_custkey = c.c_custkey WHERE l.l_shipdate > o.o_orderdate AND o.o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' AND c.c_mktsegment = 'MACHINERY'",
        "spj_4way_name_key": f"SELECT l.l_orderkey, n.n_name {ln} WHERE n.n_name = 'NATION_3' AND n.n_nationkey = 3 AND l.l_discount >= 0.05",
        "spj_4way_contradiction": f"SELECT l.l_orderkey, c.c_name {ln} WHERE n.n_name = 'NATION_3' AND n.n_nationkey = 4",
        "spj_5way_two_nations": f"SELECT l.l_orderkey, s.s_name {ln} JOIN {t}supplier s ON l.l_suppkey = s.s_suppkey WHERE s.s_nationkey = c.c_nationkey AND n.n_name <> 'NATION_1' AND s.s_acctbal > 0.0",
        "spj_2way_control_wide": f"SELECT o.o_orderkey, c.c_custkey {oc} WHERE o.o_totalprice < 20000.0",
    }


@dataclass(frozen=True)
class WorkloadItem:
    """A query of a workload."""

    id: str
    sql: str
    description: str
    join_width: int
    selectivity_tag: str = ""


def aliases_for(tables: tuple[str, ...]) -> dict[str, str]:
    """Initials of the parts of each name, numbered where they clash."""
    out: dict[str, str] = {}
    for t in tables:
        base = "".join(p[0] for p in t.split("_") if p).lower() or "t"
        alias, n = base, 2
        while alias in out.values():
            alias, n = f"{base}{n}", n + 1
        out[t] = alias
    return out


def predicate(spark: SparkSession, full: str, alias: str, column: str, kind, rng: random.Random) -> str | None:
    """A condition on real values: a sampled text, a quartile, or the latest time. None if the
    column has no values or is of another type."""
    frame = spark.table(full)
    if isinstance(kind, TEXT):
        values = [r[0] for r in frame.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(5).collect()]
        return f"{alias}.{column} = '{rng.choice(values).replace(chr(39), chr(39) * 2)}'" if values else None
    if isinstance(kind, NUMERIC):
        found = group_percentiles(value_counts(frame, [], F.col(column)), [], [0.25, 0.75], discrete=True).select("p0", "p1").first()
        if found is None:
            return None
        q = [int(v) if isinstance(kind, T.IntegralType) else v for v in found]
        if q[0] == q[1]:
            return f"{alias}.{column} = {q[0]}"
        return f"{alias}.{column} > {q[0]}" if rng.random() < 0.5 else f"{alias}.{column} < {q[1]}"
    if isinstance(kind, TEMPORAL):
        latest = frame.agg(F.max(column).cast("string")).first()[0]
        return f"{alias}.{column} <= TIMESTAMP '{latest}'" if latest else None
    return None


def _connected(graph: SchemaGraph, tables: tuple[str, ...]) -> list[str]:
    order = [tables[0]]
    while len(order) < len(tables):
        order.append(next(t for t in tables if t not in order and set(graph.neighbours(t)) & set(order)))
    return order


def generate(spark: SparkSession, database: str, graph: SchemaGraph, n: int = 25, widths: tuple[int, ...] = (2, 3, 4), seed: int = 42) -> list[WorkloadItem]:
    """Queries over connected tables with one or two conditions on sampled values each."""
    rng = random.Random(seed)
    keys = {(k.table, k.column) for k in graph.keys} | {(k.target, k.target_column) for k in graph.keys}
    out: list[WorkloadItem] = []
    for width in widths:
        subsets = graph.connected_subsets(width, 4 * max(1, n // len(widths)))
        rng.shuffle(subsets)
        for tables in subsets[: n // len(widths)]:
            names = aliases_for(tables)
            order = _connected(graph, tables)
            text = f"FROM {database}.{order[0]} {names[order[0]]}"
            for i, t in enumerate(order[1:], 1):
                ons = [c for u in order[:i] if (c := graph.join_condition(t, u, names))]
                text += f" JOIN {database}.{t} {names[t]} ON {' AND '.join(ons)}"
            usable = [(t, c, k) for t in order for c, k in graph.columns[t].items() if (t, c) not in keys]
            rng.shuffle(usable)
            found = []
            for t, c, k in usable:
                p = predicate(spark, f"{database}.{t}", names[t], c, k, rng)
                if p:
                    found.append(p)
                if len(found) == 2:
                    break
            if not found:
                continue
            shown = ", ".join(f"{names[t]}.{next(iter(graph.columns[t]))}" for t in order[:3])
            sql = f"SELECT {shown} {text} WHERE {' AND '.join(found)}"
            out.append(WorkloadItem(f"gen_{width}w_{len(out)}", sql, f"{width}-way over {', '.join(order)}", width, f"{len(found)} conditions"))
    return out
