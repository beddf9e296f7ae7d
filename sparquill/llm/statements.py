"""One canonical text for all formattings of a SQL statement.

Not formatting: operators, the characters of numbers, the order of joins and of the two sides
of a comparison. Formatting: white space, letter case (in literals too), parentheses, quoting
of names, semicolons, the order of selected columns and of AND-ed conditions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex

#: A literal, a quoted name, a number or word, an operator, or any other character.
_TOKEN = regex.compile(
    r"""(?P<literal>'(?:[^']|'')*(?:'|$))|"(?P<name>[^"]*)"|`(?P<tick>[^`]*)`|(?P<word>[\p{L}\p{N}_$]+(?:\.\p{N}+)?)|(?P<op><=|>=|<>|!=|\|\||::|[<>=])|(?P<other>\S)""",
)
#: Words that begin a clause; lists and conditions do not reach over them.
_CLAUSES = frozenset("select from join on where group order having limit offset union intersect except left right inner full cross using".split())
_SORTED_BY_COMMA = frozenset({"select"})
_SORTED_BY_AND = frozenset({"where", "on", "having"})


def _tokens(text: str) -> Iterator[str]:
    for m in _TOKEN.finditer(text.lower()):
        kind = m.lastgroup
        if kind == "literal":
            whole = m.group()
            inner = whole[1:-1] if len(whole) > 1 and whole.endswith("'") else whole[1:]
            yield "'" + " ".join(inner.split()) + "'"
        elif kind in ("name", "tick"):
            yield " ".join(m.group(kind).split())
        else:
            yield m.group()


def _tree(tokens: list[str]) -> list:
    """Tokens with each pair of parentheses as a list of its own."""
    out: list = []
    stack = [out]
    for t in tokens:
        if t == "(":
            stack.append([])
            stack[-2].append(stack[-1])
        elif t == ")":
            if len(stack) > 1:
                stack.pop()
        else:
            stack[-1].append(t)
    return out


def _plain(tree: list) -> str:
    return " ".join(x for x in (t if isinstance(t, str) else _condition(t) for t in tree) if x)


def _conditions(tree: list) -> list[str]:
    """The AND-ed conditions of a stretch without OR; parentheses that only hold such are undone."""
    parts: list[list] = [[]]
    between = False
    for t in tree:
        if t == "and" and not between:
            parts.append([])
            continue
        between = t == "between" or (between and t != "and")
        parts[-1].append(t)
    out = []
    for part in parts:
        if len(part) == 1 and isinstance(part[0], list):
            out += [_condition(part[0])] if "or" in part[0] else _conditions(part[0])
        else:
            out.append(_plain(part))
    return [c for c in out if c]


def _condition(tree: list) -> str:
    """A condition with the parts of its ANDs in order; OR binds less, so it bounds what may move."""
    runs: list[list] = [[]]
    for t in tree:
        if t == "or":
            runs.append([])
        else:
            runs[-1].append(t)
    return " or ".join(" and ".join(sorted(_conditions(r))) for r in runs)


def _flush(clause: str, parts: list[list[str]], out: list[str]) -> None:
    """Append a clause; ``parts`` are its pieces, the selected columns or one piece."""
    if clause in _SORTED_BY_AND:
        body = _condition(_tree(parts[0]))
    else:
        pieces = [" ".join(p) for p in parts]
        head = ""
        if clause in _SORTED_BY_COMMA and len(pieces) > 1:
            if pieces[0].startswith("distinct "):
                head, pieces[0] = "distinct ", pieces[0][9:]
            pieces = sorted(pieces)
        body = head + " , ".join(pieces)
    text = f"{clause} {body}".strip()
    if text:
        out.append(text)


def canonical(text: str) -> str:
    """The canonical text of a statement; '' for a text of only blanks, parentheses or semicolons.

    A comma inside parentheses separates arguments, not selected columns, and the AND of a
    BETWEEN separates bounds, not conditions, so neither is a place to reorder at. Beside an OR,
    conditions change places only between the same two ORs, and a condition in parentheses with
    an OR in it moves as a whole.
    """
    out: list[str] = []
    clause, parts, depth, base = "", [[]], 0, 0
    for t in _tokens(text):
        if t == ";":
            continue
        if t in "()":
            depth += (t == "(") - (t == ")")
            if depth < base:  # the end of a query in parentheses ends its last clause
                _flush(clause, parts, out)
                clause, parts, base = "", [[]], depth
            elif clause in _SORTED_BY_AND:
                parts[0].append(t)
        elif t in _CLAUSES:
            if clause or parts[0]:
                _flush(clause, parts, out)
            clause, parts, base = t, [[]], depth
        elif t == "," and clause in _SORTED_BY_COMMA and depth <= base:
            parts.append([])
        else:
            parts[-1].append(t)
    if clause or parts[0]:
        _flush(clause, parts, out)
    return " ".join(out)


def canonical_array(texts: pa.Array) -> pa.Array:
    """``canonical`` of each text, computed once per different text; null stays null."""
    coded = texts.dictionary_encode()
    words = pa.array([canonical(t) for t in coded.dictionary.to_pylist()], pa.string())
    return words.take(coded.indices)


def digests(texts: pa.Array) -> pa.Array:
    """128-bit digests, for joins that need not carry the texts."""
    coded = texts.dictionary_encode()
    keys = pa.array([hashlib.blake2b(t.encode(), digest_size=16).digest() for t in coded.dictionary.to_pylist()], pa.binary())
    return keys.take(coded.indices)


def first_places(codes: pa.Array) -> pa.Array:
    """Boolean: is this the first row of its value in the array?"""
    n = len(codes)
    at = pa.array(range(n), pa.int64())
    first = pa.table({"k": codes, "i": at}).group_by("k").aggregate([("i", "min")])["i_min"]
    return pc.is_in(at, value_set=first.combine_chunks())
