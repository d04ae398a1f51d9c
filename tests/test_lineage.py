import random

import numpy as np
import pytest
from conftest import rows

from loomgraph.operators import lineage as G
from loomgraph.operators.closures import closure_counts
from loomgraph.plans import commands as K


def graph(spark, pairs, labels=None):
    ids = sorted({x for p in pairs for x in p})
    nodes = spark.createDataFrame(
        [(i, (labels or {}).get(i, i), "technique", "general", None) for i in ids],
        "id string, canonical string, ptype string, domain string, month string")
    return spark.createDataFrame(pairs, "src string, dst string"), nodes


def test_cycle(spark):
    e, n = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c")])
    up, down, both = (G.lineage(e, n, "a", d) for d in ("ancestors", "descendants", "anything"))
    assert (both.ancestors, both.descendants) == (2, 3)
    assert rows(up.ids) == [("a",), ("b",), ("c",)]
    assert rows(down.ids) == rows(both.ids) == [("a",), ("b",), ("c",), ("d",)]


def test_both_is_not_the_component(spark):
    e, n = graph(spark, [("a", "b"), ("c", "b")])
    assert rows(G.lineage(e, n, "a").ids) == [("a",), ("b",)]


def test_lookup_by_label(spark):
    e, n = graph(spark, [("self rag", "rag")], {"self rag": "Self-RAG"})
    assert G.lineage(e, n, "Self-RAG").key == "self rag"
    assert G.lineage(e, n, "Self-RAG", strict_lower=True) is None
    assert G.lineage(e, n, "nothing") is None


@pytest.mark.parametrize("seed", [1, 2])
def test_random_closure(spark, seed):
    rnd = random.Random(seed)
    pairs = list({(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}") for _ in range(45)} | {("n0", "n1")})
    e, n = graph(spark, pairs)

    reach = np.eye(30, dtype=bool)
    for a, b in pairs:
        reach[int(a[1:]), int(b[1:])] = True
    for _ in range(5):  # paths of up to 2**5 edges
        reach = reach @ reach
    up, down = ({f"n{i}" for i in np.flatnonzero(r)} for r in (reach[0], reach[:, 0]))

    got = G.lineage(e, n, "n0")
    assert {r["id"] for r in got.ids.collect()} == up | down
    assert (got.ancestors, got.descendants) == (len(up) - 1, len(down) - 1)


def test_long_chain_keeps_few_tables(spark, monkeypatch, tmp_path):
    from loomgraph import session
    monkeypatch.setattr(session, "ensure_checkpoint_dir", lambda s: f"file://{tmp_path}")
    e, _ = graph(spark, [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(40)])
    start = spark.createDataFrame([("n00",)], "id string")
    assert G.closure(e, start, "ancestors").count() == 40
    assert sum(1 for _ in tmp_path.glob("tables-*/*")) <= G.MERGE_LEVELS + 2


def test_checkpoints_need_a_shared_folder(monkeypatch):
    from loomgraph import session

    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.ensure_checkpoint_dir(Session())


def test_commands(spark):
    e, n = graph(spark, [("self rag", "rag"), ("rag", "bm25")], {"self rag": "Self-RAG"})
    none = K.run(K.FilterRequest(ptype="survey"), n, e)
    assert not none.changed and none.ids is None
    some = K.run(K.FilterRequest("technique", "general"), n, e)
    assert some.chips == ["ptype=technique", "domain=general"] and some.ids.count() == 3
    assert rows(some.edges) == [("rag", "bm25"), ("self rag", "rag")]
    assert K.FilterRequest().summary() == "all"
    assert K.FilterRequest("survey", None, "2024-01").summary() == "survey · from 2024-01"
    line = K.run(K.LineageRequest("Self-RAG", "ancestors"), n, e)
    assert line.chips == ["lineage=Self-RAG"] and "ancestors 2" in line.message
    assert not K.run(K.LineageRequest("zzz"), n, e).changed
    assert K.run(K.ResetRequest(), n, e).changed


def test_tool_calls(spark):
    _, n = graph(spark, [("self rag", "rag")], {"self rag": "Self-RAG"})
    ok = {"tool": "focus_lineage", "args": {"node": "Self-RAG"}}
    assert K.checked_call(ok, n) == ok
    assert K.checked_call(ok, n, strict_lower=True)["tool"] is None
    assert K.checked_call({"tool": "focus_lineage", "args": {"node": "zzz"}}, n)["tool"] is None
    assert K.checked_call({"tool": None, "message": "m" * 500}, n)["message"] == "m" * 200
    assert K.to_request({"tool": "filter", "args": {"domain": "medical"}}) == K.FilterRequest(domain="medical")
    assert K.to_request({"tool": "collect", "args": {"topic_text": "x"}}) == K.CollectRequest("x")
    assert K.to_request({"tool": "what"}) is None
    assert K.to_request(ok) == K.LineageRequest("Self-RAG", "both")


@pytest.mark.parametrize("text, call", [
    ("show only benchmark nodes", ("filter", {"ptype": "benchmark"})),
    ("medical technique nodes after 2024-05", ("filter", {"ptype": "technique", "domain": "medical", "date_after": "2024-05"})),
    ("what came out since 2024", ("filter", {"date_after": "2024-01"})),
    ("lineage of self-RAG please", ("focus_lineage", {"node": "Self-RAG", "direction": "both"})),
    ("ancestors of rag", ("focus_lineage", {"node": "rag", "direction": "ancestors"})),
    ("lineage of zzz", (None, None)),
    ("show everything", ("reset", {})),
    ("collect papers on retrieval", ("collect", {"topic_text": "collect papers on retrieval"})),
    ("hm", (None, None)),
])
def test_offline_translator(spark, text, call):
    from loomgraph.external import KeywordTranslator
    names = spark.createDataFrame([("Self-RAG",), ("rag",), ("",)], "canonical string")
    got = KeywordTranslator().translate(text, names)
    assert (got["tool"], got.get("args")) == call


@pytest.mark.parametrize("seed, words", [(1, 1), (2, 2)])
def test_closure_counts_of_every_node(spark, seed, words):
    """Several blocks of starts, cycles, loops and a long chain against a reachability matrix."""
    rng = random.Random(seed)
    names = [f"n{i:03d}" for i in range(150)]
    pairs = [(rng.choice(names[:90]), rng.choice(names[:90])) for _ in range(110)] + list(zip(names[90:], names[91:])) + [("n001", "n001"), ("n140", "n130")]
    ids = sorted({x for p in pairs for x in p})
    at = {x: i for i, x in enumerate(ids)}
    reach = np.eye(len(ids), dtype=bool)
    for a, b in pairs:
        reach[at[a], at[b]] = True
    while True:
        more = reach | ((reach.astype(int) @ reach.astype(int)) > 0)
        if (more == reach).all():
            break
        reach = more
    want = sorted((x, int(reach[i].sum()) - 1, int(reach[:, i].sum()) - 1) for i, x in enumerate(ids))
    e, _ = graph(spark, pairs + pairs[:5])
    assert rows(closure_counts(e, words), "id", "n_ancestors", "n_descendants") == want


def test_closure_counts_of_nothing(spark):
    assert closure_counts(spark.createDataFrame([], "src string, dst string")).count() == 0
    assert rows(closure_counts(spark.createDataFrame([("a", "a")], "src string, dst string"))) == [("a", 0, 0)]


def test_closure_counts_search_what_cycles_and_hubs_leave(spark, monkeypatch):
    """A large cycle with rows of nodes before and behind it: nothing is left to be searched for."""
    from loomgraph.operators import closures
    blocks = []
    monkeypatch.setattr(closures, "weigh", lambda *a: blocks.append(a))
    ring = [(f"r{i}", f"r{(i + 1) % 12}") for i in range(12)]
    ends = [(f"a{i}", f"r{i % 12}") for i in range(200)] + [(f"r{i % 12}", f"z{i}") for i in range(200)] + [(f"a{i}", f"z{i}") for i in range(200)]
    e, _ = graph(spark, ring + ends)
    got = {r["id"]: (r["n_ancestors"], r["n_descendants"]) for r in closure_counts(e, 2).collect()}
    assert not blocks and len(got) == 412
    assert {got[f"r{i}"] for i in range(12)} == {(211, 211)}
    assert {got[f"a{i}"] for i in range(200)} == {(212, 0)} and {got[f"z{i}"] for i in range(200)} == {(0, 212)}


def knots(seed):
    """Edges of a random graph with cycles, a hub, nodes beside it, rows of nodes and layers without cycles."""
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)] + [(60 + i, 61 + i) for i in range(30)]
    edges += [(100 + rng.randrange(40), 7) for _ in range(40)] + [(7, 150 + rng.randrange(40)) for _ in range(40)]
    edges += [(100 + rng.randrange(40), 200 + rng.randrange(20)) for _ in range(40)] + [(200 + rng.randrange(20), 150 + rng.randrange(40)) for _ in range(40)]
    edges += [(230 + a, 230 + a + 1 + rng.randrange(4)) for a in range(40) for _ in range(2)]
    return [(f"n{a:03d}", f"n{b:03d}") for a, b in edges]


def closure_sizes(pairs):
    """id, n_ancestors, n_descendants by a walk from each node."""
    to, ids = {}, sorted({x for p in pairs for x in p})
    for a, b in pairs:
        to.setdefault(a, set()).add(b)
    above = {}
    for x in ids:
        seen, todo = {x}, [x]
        while todo:
            new = to.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        above[x] = seen - {x}
    return [(x, len(above[x]), sum(x in above[y] for y in ids)) for x in ids]


@pytest.mark.parametrize("limits", [{}, {"WALK": 0}, {"WALK": 0, "PASSES": 1}, {"NUMBERS": 0, "HELD": 0}])
def test_closure_counts_within_and_beyond_memory(spark, monkeypatch, limits):
    """Components and closures in arrays, partly in arrays and in tables alone say the same."""
    from loomgraph.operators import closures, reach
    monkeypatch.setattr(reach, "PIECE", 8)
    for name, value in limits.items():
        monkeypatch.setattr(closures, name, value)
    pairs = knots(len(limits))
    e, _ = graph(spark, pairs)
    assert rows(closure_counts(e, 4), "id", "n_ancestors", "n_descendants") == closure_sizes(pairs)


def test_closure_counts_tables_do_not_grow_with_starts(spark, monkeypatch, tmp_path):
    """Seven times 64 nodes that neither cycles nor hubs replace: as many tables as for one."""
    from loomgraph import session
    monkeypatch.setattr(session, "ensure_checkpoint_dir", lambda s: f"file://{tmp_path}")
    rng = random.Random(5)
    pairs = [(f"n{a:03d}", f"n{a + 1 + rng.randrange(30):03d}") for a in range(420) for _ in range(2)]
    e, _ = graph(spark, pairs)
    assert rows(closure_counts(e, 1), "id", "n_ancestors", "n_descendants") == closure_sizes(pairs)
    assert sum(1 for _ in tmp_path.glob("tables-*/*")) <= 12


@pytest.mark.parametrize("size, words", [(3, 1), (10, 1 << 22), (4096, 1)])
def test_pieces_and_sweeps(monkeypatch, size, words):
    from loomgraph.operators import reach
    monkeypatch.setattr(reach, "WORDS", words)
    for seed in range(30):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(2, 120))
        a, b = rng.integers(0, n, (2, int(rng.integers(1, 4 * n))))
        if seed % 3 == 0:
            a[::2] = n // 2
        edges = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0)
        s, t, weight = edges[:, 0], edges[:, 1], rng.integers(1, 9, n)
        s2, t2, w_up, w_down, rounds = reach.fold(n, s, t, weight)
        left = reach.pieces(n, s2, t2, w_up, w_down, size)
        up, down, orders = left.add_up, left.add_down, {}
        for block in left.blocks():
            v_up, n_up, v_down, n_down = reach.answer(left, *block, orders)
            up[v_up] += n_up
            down[v_down] += n_down
        reach.unfold(up, down, w_up, w_down, rounds)
        met = np.eye(n, dtype=int)
        for a, b in edges[::-1]:  # targets of a node come before it
            met[a] |= met[b]
        assert (up == met @ weight).all() and (down == weight @ met).all()


def test_components_of_long_and_crossed_walks():
    from loomgraph.operators import reach
    n = 20000
    ring = np.arange(n)
    comp = reach.strong(n + 3, np.append(ring, [0, n, n + 1]), np.append((ring + 1) % n, [n, n + 1, n]))
    assert len(set(comp[:n])) == 1 and comp[n] == comp[n + 1] != comp[0] and comp[n + 2] == n + 2
