import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparquill.operators.nested import StructuralIndex, flatten_lists, flatten_nodes, unwrap

KEY = "Node Type"


def indexed(texts):
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)]).astype(np.int64)
    return StructuralIndex(np.frombuffer(b"".join(data), np.uint8), offsets)


def brute(text):
    try:
        value = json.loads(text)
    except ValueError:
        return []
    out = []

    def walk(v, parent):
        if isinstance(v, dict):
            if KEY in v:
                out.append((len(out), parent))
                parent = len(out) - 1
            for x in v.values():
                walk(x, parent)
        elif isinstance(v, list):
            for x in v:
                walk(x, parent)

    walk(value, -1)
    return out


def nodes(texts):
    f = indexed(texts).nodes(KEY.encode())
    out = [[] for _ in texts]
    for r, n, p in zip(f["row"], f["no"], f["parent"], strict=True):
        out[r].append((int(n), int(p)))
    return out


scalars = st.none() | st.booleans() | st.integers(-5, 5) | st.floats(allow_nan=False, allow_infinity=False) | st.text('ab"\\{}[]:, \n\té', max_size=6) | st.just(KEY)
values = st.recursive(scalars, lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from([KEY, "Plans", "a", '"', "\\"]), c, max_size=3), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(values, st.sampled_from([None, 0, 2])), min_size=1, max_size=5), st.integers(0, 60))
def test_equals_a_parser(docs, cut):
    texts = [json.dumps(v, indent=i) for v, i in docs]
    texts = [t for t in texts if t.lstrip()[:1] in "{["] + [texts[0][:cut]]
    texts = [t for t in texts if not t.startswith('"')]
    assert nodes(texts) == [brute(t) for t in texts]


def test_incomplete_and_malformed_texts():
    good = '{"Node Type":"A","Plans":[{"Node Type":"B"}]}'
    broken = [good[:k] for k in range(len(good))] + [good + "x", good + good, good[:-1] + "]", '{"Node Type" "A"}', '{"Node Type":}', '{,"Node Type":1}', '[{"Node Type":1},]', "{'Node Type':1}", ""]
    assert nodes([good, *broken])[1:] == [[] for _ in broken]
    assert nodes([" \n" + good + "\t"])[0] == [(0, -1), (1, 0)]


@pytest.mark.parametrize("bare", ["0", "-0", "12", "-7", "1.50", "0.5", "-0.25", "1e5", "1E-3", "-2.5e+10", "true", "false", "null", " 3 ", "\n12.0\t"])
def test_bare_values(bare):
    assert nodes([f'{{"Node Type":{bare}}}', f'[{bare},{{"Node Type":[1,{bare}]}}]']) == [[(0, -1)], [(0, -1)]]


@pytest.mark.parametrize("bare", ["foo", "01", "-", "+1", "1.", ".5", "1..2", "1.2.3", "1e", "--1", "1-2", "tru", "True", "nullx", "1 2", "0x1", "-01", "NaN"])
def test_what_is_no_value_makes_a_text_incomplete(bare):
    assert nodes([f'{{"Node Type":{bare}}}', f'[1,{bare}]', '{"Node Type":1}']) == [[], [], [(0, -1)]]


def test_numbers_of_inner_nodes():
    f = indexed(['{"Node Type":1,"P":[{"Node Type":2,"P":{"Node Type":3}},{"Node Type":4}]}', "[]", '{"Node Type":1}']).nodes(KEY.encode())
    assert f["inside"].tolist() == [3, 1, 0, 0, 0]


def test_key_is_no_value_and_no_deeper_key():
    assert nodes(['{"a":"Node Type","b":{"c":["Node Type"]}}', '{"a":{"Node Type":1}}'])[0] == []
    assert nodes(['{"x":[{"Node Type":1},{"y":{"Node Type":2}}],"Node Type":0}'])[0] == [(0, -1), (1, 0), (2, 0)]


def test_unwrap():
    inner = '{"Node Type":"A"}'
    assert unwrap(json.dumps(json.dumps(inner))) == inner
    assert unwrap('"broken') == "" and unwrap("") == ""


def test_rows_and_attributes(spark):
    long = json.dumps({KEY: "R", "Plans": [{KEY: f"n{i}", "Rows": i} for i in range(3000)]})
    data = [(1, '{"Node Type":"A","Rows":3,"Plans":[{"Node Type":"B \\"q\\"","Rows": null }]}', 9), (2, None, 9), (3, "", 9), (4, json.dumps('{"Node Type":"W"}'), 9), (5, long, 9), (5, "[]", 9)]
    df = spark.createDataFrame(data, "id long, raw string, node_no int")
    rows = sorted(map(tuple, flatten_nodes(df, "id", "raw", KEY, [KEY, "Rows"]).where("id < 5").collect()))
    assert rows == [(1, 0, -1, 0, 1, "A", "3"), (1, 1, 0, 1, 0, 'B \\"q\\"', None), (4, 0, -1, 0, 0, "W", None)]
    assert flatten_nodes(df, "id", "raw", KEY).where("id = 5").count() == 3001
    assert flatten_nodes(df.limit(0), "id", "raw", KEY).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(scalars | st.lists(scalars, max_size=2) | st.dictionaries(st.sampled_from(["a", "L"]), scalars, max_size=2), max_size=5), st.sampled_from([None, 0, 2])), min_size=1, max_size=4))
def test_items_of_lists(lists):
    texts = [json.dumps({KEY: 1, "x": {"L": ["no"]}, "L": items}, indent=i) for items, i in lists]
    index = indexed(texts)
    found = index.nodes(KEY.encode())
    node, no, begin, end = index.items(b"L", found["span"])
    got = [[] for _ in texts]
    for k, n, a, b in zip(found["row"][node], no, begin, end, strict=True):
        assert n == len(got[k])
        raw = index.data[a:b].tobytes().decode()
        quoted = a > 0 and index.data[a - 1 : a].tobytes() == b'"'
        got[k].append(None if a < 0 else json.loads(f'"{raw}"' if quoted else raw))
    want = [[x if isinstance(x, str | int | float | bool) else None for x in items] for items, _ in lists]
    assert got == want


def test_child_tables_and_inner_objects(spark):
    texts = [(1, json.dumps({KEY: "A", "L": ["x", 2, None, {"L": [9]}], "In": {"Deep": {"v": 7}}, "Plans": [{KEY: "B", "L": []}, {KEY: "C", "L": [True]}]}), 0), (2, None, 0), (3, "{", 0), (4, json.dumps(json.dumps({KEY: "W", "L": ["w"]})), 0)]
    df = spark.createDataFrame(texts, "id long, raw string, item_no int")
    rows = sorted(map(tuple, flatten_lists(df, "id", "raw", KEY, ["L", "none"]).collect()))
    assert rows == [(1, 0, "L", 0, "x"), (1, 0, "L", 1, "2"), (1, 0, "L", 2, None), (1, 0, "L", 3, None), (1, 2, "L", 0, "true"), (4, 0, "L", 0, "w")]
    inner = flatten_nodes(df, "id", "raw", KEY, [("In", "Deep", "v"), ("In", "v"), "In"]).orderBy("id", "node_no").collect()
    assert [(r["attr_0"], r["attr_1"], r["attr_2"]) for r in inner] == [("7", None, None)] + [(None, None, None)] * 3
    assert flatten_lists(df.limit(0), "id", "raw", KEY, ["L"]).count() == 0
