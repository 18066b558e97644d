"""Secret scans with multipart credential linking, by DataFrame functions only.

Base spans are found by three patterns. The linking method adds weak parts,
which alone mean little: identifiers (user names, client ids), opaque tokens and
endpoints. A scope is a paragraph, and parts are within reach of each other if
their intervals, widened by ``REACH`` code points, meet in one scope. A weak
part is reported only if complementary parts are within reach:

* an opaque token next to an identifier, an access key or an endpoint
* an identifier or an endpoint next to a secret, be it a base span or a token

Positions are code points. ``split`` and ``regexp_extract_all`` by the same
pattern give gaps and matches in turn; their lengths add up to positions. The
join of intervals is a merge: parts and their possible partners are sorted by
start, and running maxima tell each part the end of the last partner before it
and the start of the first one after it. Running sums and maxima are found within
chunks and over chunks, so that a text of any length takes little more than
linear time.

A null text is an empty one; an empty text has no spans. Spans that start equal
are in the order of their kinds. Repeated rows give a row each, an empty table an
empty one. Extra columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENTIFIER = r"""(?<![A-Za-z0-9_])(?i:user(?:_?name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}"""
ENDPOINT = r"""(?<![A-Za-z0-9])(?:https?|ftp|ssh|amqps?|mysql|postgres(?:ql)?|mongodb|redis)://[^\s"'<>]+|(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?(?![\w]|\.[0-9])"""
OPAQUE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])"
MIN_ASSIGNED = 6
REACH = 300
#: Kinds in the order that parts equal starts.
KINDS = ("assign", "access", "hex", "opaque", "identifier", "endpoint")


_NONE = "CAST(array() AS array<struct<start:int,k:int,stop:int,scope:int>>)"
_POWERS = ", ".join(str(1 << i) for i in range(31))
#: Scopes and positions are one number, the scope in its upper half.
_SCOPE, _TOP = 1 << 32, 1 << 62
#: Values whose running results are found one after the other; their array is copied for each.
_CHUNK = 24

# Expressions are SQL text, which the parser reads at once; hundreds of nested lambdas built call by call take seconds.


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` evaluated once as ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(values: str, op: Callable[[str, str], str]) -> str:
    """Running results of an associative ``op`` over an array of longs: within chunks, by doubling over the chunks' last results, and both together."""
    grown = f"(acc, x) -> array_append(acc, IF(size(acc) = 0, x, {op('x', 'element_at(acc, -1)')}))"
    chunks = f"transform(sequence(1, greatest(size(vals), 1), {_CHUNK}), c0 -> aggregate(slice(vals, c0, {_CHUNK}), CAST(array() AS array<bigint>), {grown}))"
    doubled = f"aggregate(slice(array({_POWERS}), 1, length(bin(size(lasts)))), lasts, (done, d) -> transform(done, (x, i) -> IF(i >= d, {op('x', 'get(done, i - d)')}, x)))"
    shifted = f"flatten(transform(chunks, (part, n) -> IF(n = 0, part, transform(part, x -> {op('x', 'get(before, n - 1)')}))))"
    joined = _let(_let("transform(chunks, part -> element_at(part, -1))", "lasts", doubled), "before", shifted)
    return _let(_let(values, "vals", chunks), "chunks", joined)


def _spans(text: str, pattern: str, kind: str, least: int = 0) -> str:
    """array of struct(start, k, stop, scope) of the matches; ``least``: length of group 2 of those that stay."""
    p = _literal(pattern)
    found = lambda g: f"regexp_extract_all({text}, {p}, {g})"
    both = f"zip_with(split({text}, {p}, -1), {found(0)}, (g, m) -> named_struct('gap', g, 'n', length(m)))"
    steps = f"filter(zip_with({both}, {found(2 if least else 0)}, (q, v) -> named_struct('gap', q.gap, 'n', q.n, 'v', length(v))), q -> q.n IS NOT NULL)"
    # a blank line ends a scope
    breaks = rf"(length(s.gap) - length(regexp_replace(s.gap, {_literal(r'\n[\x20\t\r]*\n')}, '\n')))"
    moves = f"transform(steps, s -> CAST({breaks} AS BIGINT) * {_SCOPE} + length(s.gap) + s.n)"
    stop = f"CAST(at % {_SCOPE} AS INT)"
    span = f"named_struct('start', {stop} - s.n, 'k', {KINDS.index(kind)}, 'stop', {stop}, 'scope', CAST(at DIV {_SCOPE} AS INT))"
    placed = _let(steps, "steps", f"zip_with(steps, {_running(moves, lambda x, y: f'{x} + {y}')}, (s, at) -> named_struct('span', {span}, 'v', s.v))")
    return f"IF({text} RLIKE {p}, transform(filter({placed}, f -> f.v >= {least}), f -> f.span), {_NONE})"


def _with_neighbours(items: str, others: str, keep: Callable[[str, str, str], str], scoped: bool) -> str:
    """The ``items`` for which ``keep(item, before, after)`` holds: the last end of ``others`` that start up to the item's
    start, and the first start of the others; both are null if there is none, with ``scoped`` in the item's scope."""
    mark = lambda spans, other: f"transform({spans}, s -> named_struct('start', s.start, 'other', {other}, 's', s))"
    merged = f"array_sort(concat({mark(items, 'false')}, {mark(others, 'true')}))"
    scope = lambda s: f"CAST({s}.scope AS BIGINT) * {_SCOPE}" if scoped else "0L"
    greatest = lambda x, y: f"greatest({x}, {y})"
    ends = f"transform(both, e -> IF(e.other, {scope('e.s')} + e.s.stop, -1L))"
    # from the end, the greatest complement is the least start
    starts = f"transform(reverse(both), e -> IF(e.other, {_TOP} - {scope('e.s')} - e.s.start, -1L))"
    sides = f"zip_with({_running(ends, greatest)}, reverse({_running(starts, greatest)}), (b, a) -> named_struct('b', b, 'a', IF(a >= 0, {_TOP} - a, NULL)))"
    here = lambda v: f"IF({v} >= {scope('j.e.s')} AND {v} < {scope('j.e.s')} + {_SCOPE}, {v} - {scope('j.e.s')}, NULL)" if scoped else f"IF({v} >= 0, {v}, NULL)"
    test = f"NOT j.e.other AND coalesce({keep('j.e.s', here('j.b'), here('j.a'))}, false)"
    return _let(merged, "both", f"transform(filter(zip_with(both, {sides}, (e, y) -> named_struct('e', e, 'b', y.b, 'a', y.a)), j -> {test}), j -> j.e.s)")


def _within_reach(items: str, others: str) -> str:
    """The items with an interval of ``others`` in their scope at most ``REACH`` away."""
    near = lambda s, before, after: f"(coalesce({before} + {REACH} >= {s}.start, false) OR coalesce({after} <= {s}.stop + {REACH}, false))"
    return f"IF(size({items}) > 0 AND size({others}) > 0, {_with_neighbours(items, others, near, scoped=True)}, {_NONE})"


def _apart(items: str, others: str) -> str:
    """The items that overlap no interval of ``others``."""
    free = lambda s, before, after: f"(coalesce({before} <= {s}.start, true) AND coalesce({after} >= {s}.stop, true))"
    return f"IF(size({items}) > 0 AND size({others}) > 0, {_with_neighbours(items, others, free, scoped=False)}, {items})"


def _joined(spans: str) -> Column:
    kinds = ", ".join(map(_literal, KINDS))
    return F.expr(f"array_join(transform(array_sort({spans}), s -> concat_ws(':', get(array({kinds}), s.k), CAST(s.start AS STRING), CAST(s.stop AS STRING))), ',')")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id``, arrays of base spans by kind, and ``linked``, the weak parts that complete a credential."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = {"assign": _spans("text", ASSIGN, "assign", MIN_ASSIGNED), "access": _spans("text", ACCESS, "access"), "hex": _spans("text", HEX, "hex")}
    df = df.select("doc_id", "text", *[F.expr(e).alias(k) for k, e in base.items()])
    df = df.withColumn("strong", F.concat("assign", "access", "hex"))
    df = df.withColumn("opaque", F.expr(f"IF(text RLIKE '[0-9]', {_spans('text', OPAQUE, 'opaque')}, {_NONE})"))
    df = df.withColumn("opaque", F.expr(_apart("opaque", "strong")))
    some = "size(strong) > 0 OR size(opaque) > 0"
    weak = {"identifier": IDENTIFIER, "endpoint": ENDPOINT}
    df = df.withColumns({k: F.expr(f"IF({some}, {_spans('text', p, k)}, {_NONE})") for k, p in weak.items()}).drop("text")
    df = df.withColumns({"taken": F.concat("strong", "opaque")}).withColumn("identifier", F.expr(_apart("identifier", "taken")))
    df = df.withColumns({"secrets": F.concat("assign", "hex", "opaque"), "parts": F.concat("identifier", "access", "endpoint")})
    partners = {"opaque": "parts", "identifier": "secrets", "endpoint": "secrets"}
    return df.withColumn("linked", F.concat(*[F.expr(_within_reach(a, b)) for a, b in partners.items()])).drop("secrets", "parts", "taken")


def secrets_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every document."""
    df = scan_secrets(docs)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return df.select("doc_id", *counts, F.sha2(_joined("strong"), 256).alias("base_sha256"), _joined("concat(strong, linked)").alias("spans"))
