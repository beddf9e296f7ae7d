"""Nested JSON texts as flat, linked tables, by a structural index.

All texts of an Arrow batch are indexed at once: bitmaps of quotes, brackets and delimiters,
string parity and nesting depth as prefix sums, spans by pairing brackets of one depth. No
text is parsed by itself but the few that are JSON strings around JSON.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_QUOTE, _ESCAPE, _OPEN_OBJECT, _CLOSE_OBJECT, _OPEN_ARRAY, _CLOSE_ARRAY, _COLON, _COMMA = range(1, 9)
_CLASS = np.zeros(256, np.uint8)
for _i, _c in enumerate(b'"\\{}[]:,', 1):
    _CLASS[_c] = _i
_SPACE = b" \t\r\n"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(_SPACE)] = True

#: Which token may follow which: nothing but white space lies between (first table), or a
#: number, true, false or null does (second table). Strings are an opening and a closing quote.
_STRING_END = 9
_BARE = np.zeros((10, 10), bool)
_FILLED = np.zeros((10, 10), bool)
_BARE[_OPEN_OBJECT, [_QUOTE, _CLOSE_OBJECT]] = True
_BARE[_OPEN_ARRAY, [_QUOTE, _OPEN_OBJECT, _OPEN_ARRAY, _CLOSE_ARRAY]] = True
_BARE[_STRING_END, [_COLON, _COMMA, _CLOSE_OBJECT, _CLOSE_ARRAY]] = True
_BARE[_COLON, [_QUOTE, _OPEN_OBJECT, _OPEN_ARRAY]] = True
_BARE[_COMMA, [_QUOTE, _OPEN_OBJECT, _OPEN_ARRAY]] = True
_BARE[_CLOSE_OBJECT, [_COMMA, _CLOSE_OBJECT, _CLOSE_ARRAY]] = True
_BARE[_CLOSE_ARRAY, [_COMMA, _CLOSE_OBJECT, _CLOSE_ARRAY]] = True
_FILLED[_OPEN_ARRAY, [_COMMA, _CLOSE_ARRAY]] = True
_FILLED[_COLON, [_COMMA, _CLOSE_OBJECT]] = True
_FILLED[_COMMA, [_COMMA, _CLOSE_ARRAY]] = True

#: A number, true, false or null.
_SCALAR = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null")

#: Bytes indexed at a time; one longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20


def _per_row(flags: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row[flags], minlength=rows)[:rows]


def _running(values: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Prefix sums that begin anew with each row."""
    total = np.cumsum(values)
    before = np.where(counts > 0, total[np.minimum(first, len(total) - 1)] - values[np.minimum(first, len(total) - 1)], 0) if len(total) else first
    return total - np.repeat(before, counts)


class StructuralIndex:
    """Tokens, depths and spans of the texts ``data[offsets[i]:offsets[i + 1]]``.

    ``complete[i]`` says whether text i is one complete JSON object or array. Only complete
    texts' objects count: ``obj_row``, ``obj_start``, ``obj_end`` (inclusive), in text order.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        rows = len(offsets) - 1
        self.data, self.offsets, self.rows = data, offsets, rows
        kind = _CLASS[data[offsets[0] : offsets[-1]]]
        pos = np.flatnonzero(kind) + offsets[0]
        kind = kind[pos - offsets[0]].astype(np.int8)
        counts = np.diff(np.searchsorted(pos, offsets))
        row = np.repeat(np.arange(rows), counts)
        quote = kind == _QUOTE
        slash = kind == _ESCAPE
        if slash.any():
            quote &= ~self._escaped(pos, row, slash)
        first = np.cumsum(counts) - counts
        seen = _running(quote.astype(np.int32), first, counts)
        inside = ((seen - quote) & 1).astype(bool)  # before the token, an odd number of quotes
        bad = (_per_row(quote, row, rows) & 1).astype(bool)
        bad |= _per_row(slash & ~inside, row, rows) > 0
        keep = quote | (~inside & ~slash & (kind != _QUOTE))
        kind, pos, row = kind[keep].copy(), pos[keep], row[keep]
        kind[quote[keep] & inside[keep]] = _STRING_END
        counts = np.bincount(row, minlength=rows)[:rows]
        first = np.cumsum(counts) - counts
        opens = (kind == _OPEN_OBJECT) | (kind == _OPEN_ARRAY)
        closes = (kind == _CLOSE_OBJECT) | (kind == _CLOSE_ARRAY)
        depth = _running(opens.astype(np.int32) - closes.astype(np.int32), first, counts)
        level = depth + closes  # of a bracket pair, the same for both
        bad |= _per_row(depth < 0, row, rows) > 0
        bad |= counts == 0
        some = np.flatnonzero(counts > 0)
        lead, tail = first[some], first[some] + counts[some] - 1
        bad[some] |= ~opens[lead] | (depth[tail] != 0) | ~closes[tail]
        bad |= _per_row(depth == 0, row, rows) != 1  # the root closes once, at the end
        self._edges(bad, some, pos[lead], pos[tail])
        self._grammar(bad, kind, pos, row)
        good = ~bad[row]
        self.kind, self.pos, self.row, self.depth, level = kind[good], pos[good], row[good], depth[good], level[good]
        self.complete = ~bad
        self._pair(level)

    @staticmethod
    def _escaped(pos: np.ndarray, row: np.ndarray, slash: np.ndarray) -> np.ndarray:
        """Tokens right after an odd number of backslashes."""
        at, r = pos[slash], row[slash]
        start = np.append(True, (np.diff(at) != 1) | (np.diff(r) != 0))
        begin = np.flatnonzero(start)
        length = np.diff(np.append(begin, len(at)))
        odd = (length & 1).astype(bool)
        last = begin[odd] + length[odd] - 1
        target = at[last] + 1
        i = np.minimum(np.searchsorted(pos, target), len(pos) - 1)
        hit = (pos[i] == target) & (row[i] == r[last])
        out = np.zeros(len(pos), bool)
        out[i[hit]] = True
        return out

    def _edges(self, bad: np.ndarray, some: np.ndarray, lead: np.ndarray, tail: np.ndarray) -> None:
        """Only white space may lie before the first and after the last bracket."""
        begin, end = self.offsets[some], self.offsets[some + 1]
        for i in np.flatnonzero((lead > begin) | (tail + 1 < end)):
            if not bad[some[i]]:
                bad[some[i]] = bool(self.data[begin[i] : lead[i]].tobytes().strip(_SPACE) or self.data[tail[i] + 1 : end[i]].tobytes().strip(_SPACE))

    def _grammar(self, bad: np.ndarray, kind: np.ndarray, pos: np.ndarray, row: np.ndarray) -> None:
        """Every token must be one that may follow the token before it."""
        if len(kind) < 2:
            return
        a, b = kind[:-1], kind[1:]
        same = (row[1:] == row[:-1]) & ~((a == _QUOTE) & (b == _STRING_END))
        at = np.flatnonzero(same)
        a, b, begin, end = a[at], b[at], pos[at] + 1, pos[at + 1]
        filled = np.zeros(len(at), bool)
        wide = np.flatnonzero(end > begin)
        # a gap holds a value if any byte in it is no white space; its first or last byte mostly tells
        filled[wide] = ~(_IS_SPACE[self.data[begin[wide]]] & _IS_SPACE[self.data[end[wide] - 1]])
        unsure = np.flatnonzero(~filled & ~_BARE[a, b] & (end - begin > 2))
        if len(unsure):
            length = end[unsure] - begin[unsure]
            start = np.cumsum(length) - length
            inner = np.repeat(begin[unsure] - start, length) + np.arange(length.sum())
            filled[unsure] = np.add.reduceat(~_IS_SPACE[self.data[inner]], start, dtype=np.int64) > 0
        ok = np.where(filled, _FILLED[a, b], _BARE[a, b])
        bad[row[at[~ok]]] = True
        bare = np.flatnonzero(filled & ok)
        bare = bare[~self._scalars(begin[bare], end[bare])]
        bad[row[at[bare]]] = True

    def _trimmed(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans without the white space at their ends; none is only white space."""
        begin, end = begin.copy(), end.copy()
        wide = np.flatnonzero(_IS_SPACE[self.data[begin]])
        while len(wide):
            begin[wide] += 1
            wide = wide[_IS_SPACE[self.data[begin[wide]]]]
        wide = np.flatnonzero(_IS_SPACE[self.data[end - 1]])
        while len(wide):
            end[wide] -= 1
            wide = wide[_IS_SPACE[self.data[end[wide] - 1]]]
        return begin, end

    def _scalars(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which spans are a number, true, false or null, by counts of digits and points; what is
        neither a plain integer nor a plain decimal is looked at by itself, once per text."""
        if not len(begin):
            return np.zeros(0, bool)
        begin, end = self._trimmed(begin, end)
        base = int(self.offsets[0])
        chunk = self.data[base : self.offsets[-1]]
        other = np.cumsum(np.append(np.int32(0), ~((chunk >= 48) & (chunk <= 57))), dtype=np.int32)
        points = np.cumsum(np.append(np.int32(0), chunk == 46), dtype=np.int32)
        first = begin + (self.data[begin] == 45)
        n_other = other[end - base] - other[np.minimum(first, end) - base]
        lead = self.data[np.minimum(first, len(self.data) - 1)]
        after = self.data[np.minimum(first + 1, len(self.data) - 1)]
        no_zero = (lead != 48) | (first + 1 >= end) | (after == 46)
        one_point = (n_other == 1) & (points[end - base] - points[np.minimum(first, end) - base] == 1) & (lead != 46) & (self.data[end - 1] != 46)
        good = (first < end) & no_zero & ((n_other == 0) | one_point)
        rest = np.flatnonzero(~good)
        if len(rest):
            texts = _slices(self.data, begin[rest], end[rest], pa.binary()).dictionary_encode()
            fits = np.array([_SCALAR.fullmatch(t) is not None for t in texts.dictionary.to_pylist()])
            good[rest] = fits[texts.indices.to_numpy()]
        return good

    def _pair(self, level: np.ndarray) -> None:
        bracket = np.flatnonzero((self.kind >= _OPEN_OBJECT) & (self.kind <= _CLOSE_ARRAY))
        self._levels = int(level.max(initial=0)) + 2
        key = self.row[bracket] * self._levels + level[bracket]
        order = bracket[np.argsort(key, kind="stable")]
        begin, end = order[0::2], order[1::2]
        mixed = self.kind[begin] + 1 != self.kind[end]
        if mixed.any():
            self.complete[self.row[begin[mixed]]] = False
        self._open_key = (self.row[begin] * self._levels + level[begin]) * self._width() + self.pos[begin]
        use = self.complete[self.row[begin]]
        self.span_row, self.span_start, self.span_end = self.row[begin], self.pos[begin], self.pos[end]
        self.span_is_object = (self.kind[begin] == _OPEN_OBJECT) & use

    def _width(self) -> int:
        return int(self.offsets[-1]) + 2

    @cached_property
    def _all_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Opening quotes of all strings that a colon follows, and the strings' lengths."""
        at = np.flatnonzero(self.kind[:-2] == _QUOTE) if len(self.kind) > 2 else np.zeros(0, np.int64)
        at = at[(self.kind[at + 2] == _COLON) & (self.row[at + 2] == self.row[at])]
        return at, self.pos[at + 1] - self.pos[at] - 1

    def keys(self, name: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(token, span) of every string ``name`` that is a key of an object: its opening
        quote's place among the tokens, and the object's among the spans."""
        at, length = self._all_keys
        at = at[length == len(name)]
        if len(at):
            # most other keys of this length differ in the first or the last byte
            start = self.pos[at] + 1
            at = at[(self.data[start] == name[0]) & (self.data[start + len(name) - 1] == name[-1])] if name else at
            text = self.data[self.pos[at][:, None] + 1 + np.arange(len(name))]
            at = at[(text == np.frombuffer(name, np.uint8)).all(axis=1)]
        key = (self.row[at] * self._levels + self.depth[at]) * self._width() + self.pos[at]
        span = np.searchsorted(self._open_key, key) - 1
        ok = (span >= 0) & self.span_is_object[np.maximum(span, 0)] if len(span) else np.zeros(0, bool)
        return at[ok], span[ok]

    def nodes(self, name: bytes) -> dict[str, np.ndarray]:
        """Objects with the key ``name``: row, no, parent, depth, span and the number of those
        inside, numbered in text order."""
        _, span = self.keys(name)
        span = np.unique(span)
        span = span[np.argsort(self.span_start[span], kind="stable")]
        row, start, end = self.span_row[span], self.span_start[span], self.span_end[span]
        n = len(span)
        first = np.searchsorted(row, row)  # rows ascend with the text
        no = np.arange(n) - first
        # ends before this start, in the row, leave the number of nodes around this one
        closed = np.searchsorted(np.sort(end), start)
        depth = np.arange(n) - closed
        order = np.argsort(row * (int(depth.max(initial=0)) + 2) + depth, kind="stable")
        top = int(depth.max(initial=0)) + 2
        width = self._width()
        keyed = (row[order] * top + depth[order]) * width + start[order]
        above = np.searchsorted(keyed, (row * top + depth - 1) * width + start) - 1
        parent = np.where(depth > 0, no[order[np.maximum(above, 0)]], -1) if n else no
        inside = np.searchsorted(start, end) - np.arange(n) - 1
        return {"row": row, "no": no, "parent": parent, "depth": depth, "span": span, "inside": inside}

    def values(self, name: bytes, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[begin, end) of the value of key ``name`` in each of ``spans``; begin is -1 without one.

        Strings come without their quotes, escapes kept; other scalars as written; null, objects
        and arrays as -1.
        """
        begin, end = np.full(len(spans), -1), np.full(len(spans), -1)
        at, span = self.keys(name)
        if not len(at) or not len(spans):
            return begin, end
        place = np.full(len(self.span_row), -1)
        place[spans] = np.arange(len(spans))
        i = place[span]
        at, i = at[i >= 0], i[i >= 0]
        colon, after = at + 2, np.minimum(at + 3, len(self.kind) - 1)
        string = self.kind[after] == _QUOTE
        scalar = (self.kind[after] == _COMMA) | (self.kind[after] == _CLOSE_OBJECT)
        a = np.where(string, self.pos[after] + 1, self.pos[colon] + 1)
        b = np.where(string, self.pos[np.minimum(after + 1, len(self.pos) - 1)], self.pos[after])
        bare = np.flatnonzero(~string & scalar)
        a[bare], b[bare] = self._trimmed(a[bare], b[bare])
        scalar[bare] = self.data[a[bare]] != ord("n")
        ok = string | scalar
        begin[i[ok]], end[i[ok]] = a[ok], b[ok]
        return begin, end


    def _opened(self, name: bytes, spans: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``spans``, token) of the brackets of a kind that begin the value of key ``name``."""
        at, span = self.keys(name)
        place = np.full(len(self.span_row), -1)
        place[spans] = np.arange(len(spans))
        i = place[span] if len(span) else span
        at, i = at[i >= 0], i[i >= 0]
        opened = self.kind[np.minimum(at + 3, len(self.kind) - 1)] == kind if len(at) else np.zeros(0, bool)
        return i[opened], at[opened] + 3

    def _span_at(self, token: np.ndarray) -> np.ndarray:
        """The spans that the opening brackets at tokens begin."""
        return np.searchsorted(self._open_key, (self.row[token] * self._levels + self.depth[token]) * self._width() + self.pos[token])

    def inner(self, name: bytes, spans: np.ndarray) -> np.ndarray:
        """The object that is the value of key ``name`` in each of ``spans``; -1 without one."""
        out = np.full(len(spans), -1)
        i, token = self._opened(name, spans, _OPEN_OBJECT)
        out[i] = self._span_at(token)
        return out

    def items(self, name: bytes, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``spans``, number, begin, end) of the scalars of the arrays of key ``name``, in
        order; null, objects and arrays among an array's items keep their numbers, begin being -1."""
        i, token = self._opened(name, spans, _OPEN_ARRAY)
        close = np.searchsorted(self.pos, self.span_end[self._span_at(token)]) if len(token) else token
        length = close - token
        owner = np.repeat(np.arange(len(token)), length)
        t = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + token[owner]
        # an item begins after the bracket and after each comma of its level
        own = (self.depth[t] == self.depth[token[owner]]) & ((t == token[owner]) | (self.kind[t] == _COMMA)) if len(t) else np.zeros(0, bool)
        t, owner = t[own], owner[own]
        begin, end = self.pos[t] + 1, self.pos[t + 1]
        string = self.kind[t + 1] == _QUOTE
        bare = (self.kind[t + 1] == _COMMA) | (self.kind[t + 1] == _CLOSE_ARRAY)
        empty = bare & (np.add.reduceat(~_IS_SPACE[np.append(self.data, 32)], np.stack([begin, end], 1).ravel())[::2] == 0) if len(t) else bare
        empty |= bare & (begin >= end)
        t, owner, begin, end, string, bare = (x[~empty] for x in (t, owner, begin, end, string, bare))
        at = np.flatnonzero(bare)
        begin[at], end[at] = self._trimmed(begin[at], end[at])
        begin[string], end[string] = self.pos[t[string] + 1] + 1, self.pos[np.minimum(t[string] + 2, len(self.pos) - 1)]
        bare[at] = self.data[begin[at]] != ord("n")
        begin[~(string | bare)] = -1
        first = np.searchsorted(owner, owner)
        return i[owner], np.arange(len(owner)) - first, begin, end


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets


def unwrap(text: str) -> str:
    """The JSON text that a JSON string holds, however often it was put into one; '' if none."""
    while text.lstrip(" \t\r\n").startswith('"'):
        try:
            text = json.loads(text)
        except ValueError:
            return ""
    return text


def _chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, StructuralIndex]]:
    """(rows of the column, index of their texts); texts inside JSON strings come apart, unwrapped."""
    data, offsets = _texts(column)
    n = len(column)
    wrapped = [i for i in _first_is_quote(data, offsets) if column[i].is_valid]
    begin = 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + CHUNK_BYTES, "right")) - 1)
        yield np.arange(begin, end), StructuralIndex(data, offsets[begin : end + 1])
        begin = end
    if wrapped:
        inner = pa.array([unwrap(column[i].as_py()) for i in wrapped], pa.large_string())
        rows = np.array(wrapped)
        for at, index in _chunks(inner):
            yield rows[at], index


def _first_is_quote(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    start, end = offsets[:-1], offsets[1:]
    some = np.flatnonzero(end > start)
    lead = data[start[some]]
    out = some[lead == ord('"')].tolist()
    for i in some[_IS_SPACE[lead]]:
        if data[start[i] : end[i]].tobytes().lstrip(_SPACE)[:1] == b'"':
            out.append(int(i))
    return out


def _slices(data: np.ndarray, begin: np.ndarray, end: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Strings (or another ``kind``) data[begin:end]; null where begin is negative."""
    null = begin < 0
    length = np.where(null, 0, end - begin)
    offsets = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(length, out=offsets[1:])
    at = np.repeat(begin - offsets[:-1], length) + np.arange(offsets[-1])
    wide = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[at].tobytes())])
    text = wide.cast(kind) if kind else wide.cast(pa.large_string()).cast(pa.string())
    return pa.compute.if_else(pa.array(~null), text, pa.scalar(None, text.type)) if null.any() else text


def _column(index: StructuralIndex, attribute: str | Sequence[str], spans: np.ndarray) -> pa.Array:
    """The scalars of an attribute of objects, or of one inside inner objects, by its path."""
    path = [attribute] if isinstance(attribute, str) else list(attribute)
    for name in path[:-1]:
        below = np.full(len(spans), -1)
        some = np.flatnonzero(spans >= 0)
        below[some] = index.inner(name.encode(), spans[some])
        spans = below
    begin, end = np.full(len(spans), -1), np.full(len(spans), -1)
    some = np.flatnonzero(spans >= 0)
    begin[some], end[some] = index.values(path[-1].encode(), spans[some])
    return _slices(index.data, begin, end)


def flatten_nodes(df: DataFrame, id_col: str, json_col: str, node_key: str, attributes: Sequence[str | Sequence[str]] = ()) -> DataFrame:
    """One row per object that has the key ``node_key``, linked to its parent and its record.

    Columns: ``id`` (of ``id_col``), ``node_no`` (from 0 in the order in which objects begin),
    ``parent_no`` (nearest enclosing node, -1 without one), ``depth``, ``inside`` (how many nodes
    follow that are inside this one), and for each of ``attributes`` a string column ``attr_<i>``: the node's scalar of that key, null if absent,
    null or not scalar. An attribute given as several names is that of an inner object, by its
    path. A JSON text inside a JSON string counts as the text it holds. Null, empty
    and incomplete texts, and scalars, have no nodes. The texts are read whole.
    """
    key, names = node_key.encode(), list(attributes)
    id_type = df.schema[id_col].dataType.simpleString()

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for rows, index in _chunks(column):
                found = index.nodes(key)
                if not len(found["row"]):
                    continue
                out = [
                    ids.take(pa.array(rows[found["row"]])),
                    *[pa.array(found[c].astype(np.int32)) for c in ("no", "parent", "depth", "inside")],
                    *[_column(index, a, found["span"]) for a in names],
                ]
                yield pa.RecordBatch.from_arrays(out, ["id", "node_no", "parent_no", "depth", "inside", *[f"attr_{i}" for i in range(len(names))]])

    extra = "".join(f", attr_{i} string" for i in range(len(names)))
    texts = df.select(F.col(id_col).alias("id"), F.col(json_col).alias("text"))
    return texts.mapInArrow(expand, f"id {id_type}, node_no int, parent_no int, depth int, inside int{extra}")


def flatten_lists(df: DataFrame, id_col: str, json_col: str, node_key: str, lists: Sequence[str]) -> DataFrame:
    """One row per item of the nodes' arrays, linked to the nodes of ``flatten_nodes``.

    Columns: ``id``, ``node_no``, ``list_name`` (one of ``lists``), ``item_no`` from 0 and
    ``value``: a scalar as ``flatten_nodes`` gives it, null for null, objects and arrays.
    Empty arrays and nodes without the array give no rows; texts count as there.
    """
    key = node_key.encode()
    id_type = df.schema[id_col].dataType.simpleString()

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for rows, index in _chunks(column):
                found = index.nodes(key)
                for name in lists if len(found["row"]) else ():
                    node, no, begin, end = index.items(name.encode(), found["span"])
                    if len(node):
                        out = [ids.take(pa.array(rows[found["row"][node]])), pa.array(found["no"][node].astype(np.int32)), pa.array([name] * len(node)), pa.array(no.astype(np.int32)), _slices(index.data, begin, end)]
                        yield pa.RecordBatch.from_arrays(out, ["id", "node_no", "list_name", "item_no", "value"])

    texts = df.select(F.col(id_col).alias("id"), F.col(json_col).alias("text"))
    return texts.mapInArrow(expand, f"id {id_type}, node_no int, list_name string, item_no int, value string")
