from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparquill.llm.duplicates import CountingTrie, RadixRules, canonical_records, collapse, copies, count_statements, oversized, partial_counts, radix_buckets
from sparquill.llm.statements import canonical

SCHEMA = "id long, sql_text string, key string, text string"


@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(1, 5), st.integers(0, 99))))
def test_trie_counts_like_a_dictionary(rows):
    trie, held = CountingTrie(), {}
    for k, n, i in rows:
        trie.add(k, n, i)
        a, b = held.get(k, (0, 1000))
        held[k] = (a + n, min(b, i))
    assert sorted((k, n, i) for k, n, i in trie.items()) == sorted((k, n, i) for k, (n, i) in held.items())


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts, 1)], SCHEMA)


def test_collapse_and_copies_equal_brute_force(spark):
    texts = [f"SELECT a{i % 7} , b FROM t WHERE x = {i % 3} AND y = 'v'" for i in range(60)] + [f"select b,a{i % 7} from t where (y='V') and x={i % 3};" for i in range(60)] + [None, "", "  ", ";"]
    groups = defaultdict(list)
    for i, t in enumerate(texts, 1):
        if t is not None:
            groups[canonical(t)].append(i)
    for rules in (RadixRules(), RadixRules(bucket_records=3, step=4)):
        got = {r["text"]: (r["first_id"], r["copies"]) for r in collapse(frame(spark, texts), "id", "sql_text", rules).collect()}
        assert got == {k: (min(v), len(v)) for k, v in groups.items()}
        pairs = {(r["first_id"], r["copy_id"]) for r in copies(frame(spark, texts), "id", "sql_text", rules).collect()}
        assert pairs == {(min(v), i) for v in groups.values() for i in v if i != min(v)}


def test_recursion_splits_until_buckets_fit(spark):
    texts = [f"select column_{i:04d} from t" for i in range(200)] + ["select same from t"] * 50
    rules = RadixRules(bucket_records=20, step=1)
    partials = partial_counts(canonical_records(frame(spark, texts).repartition(8), "id", "sql_text"), rules)
    placed = radix_buckets(partials, rules)
    assert placed.count() == partials.count()
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("bytes").alias("texts")).collect()
    assert all(r["n"] <= 20 or r["texts"] == 1 for r in sizes) and len(sizes) >= 10


def test_levels_skip_what_all_texts_share(spark):
    head = b"x" * 5000
    rest = spark.createDataFrame([(head + bytes([c]), b"x") for c in b"abcdef"], "bytes binary, bucket binary")
    assert [r["length"] for r in oversized(rest, RadixRules(bucket_records=2, step=3)).collect()] == [5003]
    ends = spark.createDataFrame([(b"ab", b"a"), (b"abc", b"a"), (b"", b""), (b"", b"")], "bytes binary, bucket binary")
    assert [(bytes(r["bucket"]), r["length"]) for r in oversized(ends, RadixRules(bucket_records=1, step=4)).collect()] == [(b"a", 6)]


def test_one_text_cannot_be_split_and_is_combined(spark):
    rules = RadixRules(bucket_records=2, step=2)
    partials = partial_counts(canonical_records(frame(spark, ["select 1"] * 40).repartition(5), "id", "sql_text"), rules)
    assert partials.count() <= 5 and partials.agg(F.sum("n")).first()[0] == 40
    assert [r["copies"] for r in count_statements(canonical_records(frame(spark, ["select 1"] * 40).repartition(40), "id", "sql_text"), rules).collect()] == [40]


def test_empty_and_repeated_ids(spark):
    assert collapse(frame(spark, []), "id", "sql_text").count() == 0
    assert copies(frame(spark, [None]), "id", "sql_text").count() == 0
    twice = spark.createDataFrame([(1, "select 1"), (1, "SELECT 1")], "id long, sql_text string")
    assert [(r["first_id"], r["copies"]) for r in collapse(twice, "id", "sql_text").collect()] == [(1, 2)]
    assert copies(twice, "id", "sql_text").count() == 0
