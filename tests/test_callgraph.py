"""Components and levels of call graphs against plain reachability."""

from __future__ import annotations

import ast
import gc
import random
from collections import Counter
from pathlib import Path

import pyarrow as pa

from stockops.operators import callgraph, graph


def plain(edges):
    names = sorted({x for e in edges for x in e})
    reach = {n: {n} for n in names}
    for _ in names:
        for a, b in edges:
            reach[a] |= reach[b]
    component = {n: min(m for m in names if m in reach[n] and n in reach[m]) for n in names}
    level = {}

    def depth(c):
        if c not in level:
            level[c] = max((1 + depth(component[b]) for a, b in edges if component[a] == c and component[b] != c), default=0)
        return level[c]

    return {n: (component[n], depth(component[n])) for n in names}


def levels(spark, edges):
    got = callgraph.call_levels(spark.createDataFrame([(f"{a:03d}" if a is not None else None, f"{b:03d}" if b is not None else None) for a, b in edges], "caller string, callee string"))
    return {int(r.name): (int(r.component), r.level) for r in got.collect()}


def test_levels_of_graphs_with_circles(spark):
    for seed, (n, m) in enumerate([(16, 20)]):
        rng = random.Random(seed)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(0, 0), (0, 0)]
        edges += [(100 + i, 101 + i) for i in range(20)] + [(120, 110)] + [(200, 100), (200, 300)]  # a chain into a circle with a tail
        assert levels(spark, [*edges, (None, 1), (2, None)]) == plain([e for e in edges if e[0] != e[1]]) | {x: (x, 0) for x in {*[a for a, b in edges if a == b], 1, 2} if x not in {y for e in edges if e[0] != e[1] for y in e}}


def test_levels_of_a_long_chain_and_of_nothing(spark):
    got = levels(spark, [(i + 1, i) for i in range(400)])
    assert got == {i: (i, i) for i in range(401)}
    assert levels(spark, []) == {}


def test_levels_of_a_deep_ladder_beside_a_circle_of_three(spark):
    # every rung calls the two below it, so no edge is led on and rounds are many; ways round the circle double in each
    edges = [(i + 1, i) for i in range(66)] + [(i + 2, i) for i in range(65)] + [(200, 201), (201, 202), (202, 200)]
    assert levels(spark, edges) == plain(edges)


def test_a_round_of_levels_groups_once_and_joins_what_is_open_once(spark, monkeypatch):
    sizes = []

    def counted(df, name):
        out = written(df, name)
        sizes.append((name, out.count()))
        return out

    written = callgraph.written
    monkeypatch.setattr(callgraph, "written", counted)
    got = levels(spark, [(10 * c + i + 1, 10 * c + i) for c in range(40) for i in range(8)])
    assert got == {10 * c + i: (10 * c + i, i) for c in range(40) for i in range(9)}
    # a round writes two tables, and what was settled is not written again in every round
    assert sum(n for name, n in sizes if name == "levels") <= 360 and {name for name, _ in sizes} <= {"names", "calls", "edges", "state", "levels"}, sizes


def test_closure_skips_what_belongs_to_roots_and_orders_callees_first(spark):
    calls = spark.createDataFrame([("r1", "a"), ("a", "b"), ("b", "a"), ("r1", "c"), ("c", "d"), ("r2", "d"), ("d", "e")], "caller string, callee string")
    roots = spark.createDataFrame([("r1", "r1"), ("r2", "r2")], "root string, name string")
    algorithms = spark.createDataFrame([("c", "r2"), ("e", "other")], "name string, algorithm string")
    found = graph.code_closure(roots, calls, algorithms=algorithms)
    order = {}
    for r in sorted(callgraph.callees_first(found, callgraph.call_levels(calls)).collect(), key=lambda r: r.place):
        order.setdefault(r.root, []).append(r.name)
    assert order == {"r1": ["a", "b", "r1"], "r2": ["e", "d", "r2"]}


def test_parts_of_batches_are_small_and_whole():
    texts = ["x" * 400, None, "", "y" * 5000, *["z" * 300] * 20]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "t"])
    parts = []
    for part in graph.small_parts([batch, batch.slice(0, 0)], 1, 1000):
        assert not gc.isenabled()
        parts.append(part)
    assert gc.isenabled()
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 1000 for p in parts) and len(parts) < 12


def test_calls_are_those_of_a_plain_walk():
    code = "class C(b()):\n    @d(1)\n    def m(self, x=e()):\n        def g(y: h()): return [i(k) for k in l() if n()]\n        return self.o(p(q), *r(), **{s(): a.b.c(t())}), (lambda: u())(), f'{v(w)}'\n"
    tree = ast.parse(code).body[0].body[0]
    want = Counter(f.id if isinstance(f, ast.Name) else f"{f.value.id if isinstance(f.value, ast.Name) else '?'}.{f.attr}" for f in (n.func for n in ast.walk(tree) if isinstance(n, ast.Call)) if isinstance(f, ast.Name | ast.Attribute))
    assert Counter(detail for kind, _, detail in graph.code_rows(code) if kind == "call") == want and len(want) > 10


def test_long_lists_of_names_are_parsed_as_two(monkeypatch):
    parsed = []
    parse = ast.parse
    monkeypatch.setattr(graph.ast, "parse", lambda x, *a: parsed.append(x) or parse(x, *a))
    words = ", ".join(f"w{i}" for i in range(500))
    assert graph.code_rows(f"def a(x):\n    return b({words})\n") == [("function", "a", None), ("call", "a", "b")]
    assert len(parsed[0]) < 60


def test_shorter_lists_change_no_row():
    bodies = [
        "f(a, b, c, d, g(e, h, i, j))", "f(a, b, c, d, *e)", "f(a, b, None, True, c)", "f(a, if, b, c, d)", "f(a, lambda, b, c, d)", "f(a, b, c, d, e) += g()",
        "f'{f(a, b, c, d)} {g(h(a, b, c, d, e))}'", "'f(a, b, c, d' + g()", "'f(a, b, c, d)' + g(h)", "f(a, b, c, d) # g(a, b, c, d)", "f(a, b, c, d, e=1, f)", "f(a, b, c, d,)", "f(a, b,\n c, d, e, g)",
        "f(a, b, c, d for d in e(a, b, c, d))", "self.m(a, b, c, d).n(a, b, c, d)", "[x for(a, b, c, d)in g(h)]", "not(a, b, c, d)", "f(a, b, c, d)(e, g, h, i)", "f(a, b, c, é)", "é(a, b, c, d, e)", "0(a, b, c, d)", "f(a b, c, d, e, g)",
    ]
    sources = [f"class K(A, B, C, D, E):\n    def m(self, a, b, c, d):\n        {x}\n\ndef g(a, b, c, d, e):\n    return {x}\n" for x in bodies]
    sources += ["def f(a, None, b, c, d): g()", "def f(a, b, c, d, *): g()", "from x import(a, b, c, d)\ndef f(): g()", "def f(x):\n    match x:\n        case C(a, b, c, d): g(a, b, c, d)\n        case(a, b, c, d, e): h()\n"]
    sources += [Path(m.__file__).read_text() for m in (ast, pa, random, graph, callgraph)]
    whole = [graph.code_rows(x.replace(", ", " , ")) for x in sources]  # no list is shortened
    assert [graph.code_rows(x) for x in sources] == whole
    assert sum(map(len, whole)) > 1000
