"""Closure sizes of every node at once: the graph is made small first, what is left is searched in bits.

Sizes of all closures are quadratic work by nature, so what can be counted without a search is taken out, with
the same results. Nodes on common cycles have the same closure: a few passes of label spreading put each such
component under one node with its size as weight. Labels of up to NUMBERS nodes travel to the tasks as one array,
and a task carries them as far as its own edges lead; components among the last WALK edges are found on the driver.
Beyond that, labels spread by joins.

Edges between components have no cycles. Up to HELD of them are taken apart in memory (`reach`: folding, splits at
hubs) into pieces without regard to their number, which the tasks sweep. More of them stay tables. With up to
64 * `words` of the components as hubs, two searches say
which hubs a node reaches and which reach it; an edge from a node that reaches a hub to one the hub reaches says
nothing new and is left out. A node whose only edge leads to or from one neighbour then has the neighbour's
closure and itself, so it is folded into the neighbour's weight and counted afterwards.

What is left is taken as starts in blocks of 64 * `words`. In a round every node passes the
starts that reached it in the round before to its targets; they are merged per target by a bitwise
or, which combines map-side, so a hub costs each task one row. A block needs as many rounds as its
longest shortest path, whatever the number of starts in it, and the work of a round is that of one
walk along the edges it still has to pass. A graph without cycles or hubs keeps all its nodes here.

From the same bits come both figures: the weight of the nodes a start has reached (its ancestors, as edges lead
to what a concept builds on), and that of the starts that have reached a node (its descendants). The state of
a block is one row of `words` numbers per node; superseded tables are removed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomgraph.operators import reach
from loomgraph.operators.ordering import with_row_index
from loomgraph.session import Scratch

COUNTS = "id {kind}, n_ancestors bigint, n_descendants bigint"
PASSES = 8       # of looking for components; what they leave is searched as it is
REPEATS = 4      # of a task's passes over its edges in a round
FOLDS = 16       # of folding nodes into their only neighbour
NODE_BITS = 40   # of a label, below its rank
NUMBERS = 1 << 24  # nodes whose labels travel as an array: 4 bytes each
STRIP = 1 << 11    # edges in a row of a packed table
SORTED = 1 << 20   # edges that are sorted before they are packed
STRIPS = "s binary, t binary"
WALK = 1 << 20     # edges whose components the driver finds itself
HELD = 1 << 22     # edges without cycles that are taken apart in memory


def numbered(scratch: Scratch, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, v), those with many edges in and out last, and edges (s, t) between their numbers, without loops, not yet written."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    ranked = ends.groupBy("id").agg((F.sum("o") * F.sum("i")).alias("rank"))
    nodes = scratch.write("nodes", with_row_index(ranked, [F.col("rank"), F.col("id")], "v").select("id", "v"))
    named = edges.filter("src <> dst").join(nodes.select(F.col("id").alias("src"), F.col("v").alias("s")), "src").join(
        nodes.select(F.col("id").alias("dst"), F.col("v").alias("t")), "dst")
    return nodes, named.select("s", "t")


def turned(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("t").alias("s"), F.col("s").alias("t"))


def degrees(pairs: DataFrame) -> DataFrame:
    """v, n_out, n_in of every node that has an edge."""
    ends = pairs.select(F.col("s").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        pairs.select(F.col("t").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("v").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


# --- components -------------------------------------------------------------------------------


def spread(scratch: Scratch, name: str, state: DataFrame, pairs: DataFrame) -> DataFrame:
    """v, x: the largest x among a node and all that reach it; `new` rows of the state are passed on."""
    state, step = scratch.write(f"{name}-0", state), 0
    while not state.filter("new").isEmpty():
        step += 1
        met = pairs.join(state.filter("new").select("v", "x"), F.col("s") == F.col("v")).groupBy("t").agg(F.max("x").alias("m"))
        nxt = state.join(met, F.col("v") == F.col("t"), "left").select(
            "v", F.greatest("x", "m").alias("x"), F.coalesce(F.col("m") > F.col("x"), F.lit(False)).alias("new"))
        state = scratch.write(f"{name}-{step}", nxt)
        scratch.remove(f"{name}-{step - 1}")
    return state.select("v", "x")


def components(scratch: Scratch, pairs: DataFrame) -> tuple[DataFrame | None, bool]:
    """v, c: nodes that share a cycle with c, c left out; and whether no other cycle is left. Labels, highest
    for nodes with many edges in and out, spread forwards; the nodes of one label that reach its first node
    are one component, and edges between labels are in none."""
    moved, rest = None, pairs
    for n in range(PASSES):
        rank = F.least(F.col("n_out") * F.col("n_in"), F.lit(1 << 22)).cast("bigint")
        label = F.call_function("shiftleft", rank, F.lit(NODE_BITS)).bitwiseOR(F.col("v"))
        core = scratch.write(f"core-{n}", degrees(rest).filter("n_out > 0 and n_in > 0").select("v", label.alias("x"), F.lit(True).alias("new")))
        inner = scratch.write(f"inner-{n}", rest.join(core.select(F.col("v").alias("s")), "s", "left_semi").join(
            core.select(F.col("v").alias("t")), "t", "left_semi").select("s", "t"))
        if inner.isEmpty():
            return moved, True
        colors = spread(scratch, f"color-{n}", core, inner)
        same = scratch.write(f"same-{n}", inner.join(colors.select(F.col("v").alias("s"), F.col("x").alias("xs")), "s").join(
            colors.select(F.col("v").alias("t"), F.col("x").alias("xt")), "t").filter("xs = xt").select("s", "t"))
        c = F.col("x").bitwiseAND(F.lit((1 << NODE_BITS) - 1))
        back = spread(scratch, f"back-{n}", colors.select("v", F.when(c == F.col("v"), 1).otherwise(0).alias("x"), (c == F.col("v")).alias("new")), turned(same))
        found = scratch.write(f"found-{n}", back.filter("x = 1").select("v").join(colors, "v").select("v", c.alias("c")))
        own = found.filter("v <> c")
        moved = own if moved is None else moved.unionByName(own)
        rest = same.join(found.select(F.col("v").alias("s")), "s", "left_anti").join(found.select(F.col("v").alias("t")), "t", "left_anti").select("s", "t")
    return moved, rest.isEmpty()


# --- components, labels in an array ---------------------------------------------------------------


def held(df: DataFrame) -> list[np.ndarray]:
    """The columns of a table, on the driver."""
    return [c.to_numpy().astype(np.int64) for c in df.toArrow().columns]


def _strip(s: np.ndarray, t: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Edges as rows of up to STRIP of them, by target, four bytes for each end."""
    by = np.argsort(t, kind="stable")
    s, t = s[by].astype(np.int32), t[by].astype(np.int32)
    for low in range(0, len(s), STRIP):
        yield pa.RecordBatch.from_arrays([pa.array([x[low:low + STRIP].tobytes()], pa.binary()) for x in (s, t)], ["s", "t"])


def strips(scratch: Scratch, pairs: DataFrame) -> DataFrame:
    """Edges are read in every round, which costs more than the work when they come a row at a time."""
    def run(batches):
        some, n = [], 0
        for b in batches:
            some.append((b.column("s").to_numpy(), b.column("t").to_numpy()))
            n += b.num_rows
            if n >= SORTED:
                yield from _strip(*map(np.concatenate, zip(*some)))
                some, n = [], 0
        if some:
            yield from _strip(*map(np.concatenate, zip(*some)))

    return scratch.write("pairs", pairs.mapInArrow(run, STRIPS))


def _ends(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield tuple(np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in b.column(c)]) for c in ("s", "t"))


def climbed(pairs: DataFrame, label: np.ndarray) -> np.ndarray:
    """The largest label among those of a node and of all that reach it along packed edges. A task passes over its edges until
    half of the labels that rose in the first pass, or more, stay."""
    sc, changed = pairs.sparkSession.sparkContext, True
    while changed:
        sent = sc.broadcast(label)

        def run(batches):
            own, edges, first = sent.value.copy(), list(_ends(batches)), 0
            for n in range(REPEATS):
                rose = 0
                for s, t in edges:
                    up = own[s] > own[t]
                    rose += int(up.sum())
                    np.maximum.at(own, t[up], own[s[up]])
                first = first or rose
                if 2 * rose <= first and n:
                    break
            v = np.flatnonzero(own != sent.value).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()]), pa.array([own[v].tobytes()])], ["v", "x"])

        label, changed = label.copy(), False
        for r in pairs.mapInArrow(run, "v binary, x binary").collect():
            v, x = np.frombuffer(r["v"], np.int32), np.frombuffer(r["x"], np.int32)
            label[v] = np.maximum(label[v], x)
            changed = changed or len(v) > 0
        sent.destroy()
    return label


def returned(pairs: DataFrame, label: np.ndarray) -> np.ndarray:
    """Whether a node reaches, among nodes of its label, the one that gave the label."""
    sc, hit, changed = pairs.sparkSession.sparkContext, label == np.arange(len(label)), True
    labels = sc.broadcast(label)
    while changed:
        sent = sc.broadcast(np.packbits(hit))

        def run(batches):
            label, old = labels.value, np.unpackbits(sent.value, count=len(labels.value)).astype(bool)
            own = old.copy()
            edges = [(s[e], t[e]) for s, t in _ends(batches) for e in [label[s] == label[t]]]
            for _ in range(REPEATS):
                met = [s[own[t] & ~own[s]] for s, t in edges]
                for v in met:
                    own[v] = True
                if not any(map(len, met)):
                    break
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(own & ~old).tobytes()])], ["v"])

        before = int(hit.sum())
        for r in pairs.mapInArrow(run, "v binary").collect():
            hit |= np.unpackbits(np.frombuffer(r["v"], np.uint8), count=len(hit)).astype(bool)
        sent.destroy()
        changed = int(hit.sum()) > before
    labels.destroy()
    return hit


def labelled(scratch: Scratch, pairs: DataFrame, n: int) -> tuple[np.ndarray, bool]:
    """The component of each of n nodes, and whether no other cycle is left: as `components`, by arrays, of packed edges."""
    comp, rest, sc = np.arange(n, dtype=np.int32), pairs, pairs.sparkSession.sparkContext
    for k in range(PASSES):
        if (rest.agg(F.sum(F.octet_length("s"))).first()[0] or 0) // 4 <= WALK:
            few = [np.empty((2, 0), np.int32), *_ends(rest.toArrow().to_batches())]
            found = reach.strong(n, *map(np.concatenate, zip(*few))).astype(np.int32)
            return np.where(found == np.arange(n), comp, found), True
        label = climbed(rest, np.arange(n, dtype=np.int32))
        hit = returned(rest, label)
        comp = np.where(hit, label, comp)
        sent = sc.broadcast((label, hit))

        def run(batches):
            label, hit = sent.value
            for s, t in _ends(batches):
                e = (label[s] == label[t]) & ~hit[s] & ~hit[t]
                yield from _strip(s[e], t[e])

        rest = scratch.write(f"rest-{k}", rest.mapInArrow(run, STRIPS))
        sent.destroy()
    return comp, rest.isEmpty()


def contracted(scratch: Scratch, nodes: DataFrame, pairs: DataFrame, comp: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, c) with their components, and edges (s, t) between these, of packed edges."""
    sent = pairs.sparkSession.sparkContext.broadcast(comp)

    def name(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sent.value[b.column("v").to_numpy()].astype(np.int64))], ["id", "c"])

    def link(batches):
        for s, t in _ends(batches):
            s, t = sent.value[s].astype(np.int64), sent.value[t].astype(np.int64)
            both = np.unique((s << 32 | t)[s != t])
            yield pa.RecordBatch.from_arrays([pa.array(both >> 32), pa.array(both & 0xFFFFFFFF)], ["s", "t"])

    kind = nodes.schema["id"].dataType.simpleString()
    of = scratch.write("of", nodes.mapInArrow(name, f"id {kind}, c bigint"))
    links = scratch.write("links", pairs.mapInArrow(link, "s bigint, t bigint").distinct())
    sent.destroy()
    return of, links


# --- searches from many starts ----------------------------------------------------------------------


def _bits(slot: Column, words: int) -> list[Column]:
    """The bit of a slot in `words` numbers; none where the slot is null."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(slot, F.lit(64)).cast("int"))
    return [F.when(F.floor(slot / 64) == k, bit).otherwise(F.lit(0).cast("bigint")) for k in range(words)]


def reached(scratch: Scratch, name: str, nodes: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """v, slot and words w0, w1, ... of each node (v, slot): which starts, the nodes with a slot, reach it, itself among them."""
    first = _bits(F.col("slot"), words)
    state = nodes.select("v", "slot", *[b.alias(f"w{k}") for k, b in enumerate(first)], *[b.alias(f"d{k}") for k, b in enumerate(first)])
    state = scratch.write(f"{name}-0", state)
    new = " or ".join(f"d{k} <> 0" for k in range(words))
    step = 0
    while not state.filter(new).isEmpty():
        step += 1
        sent = state.filter(new).select("v", *[f"d{k}" for k in range(words)])
        met = pairs.join(sent, pairs["s"] == sent["v"]).groupBy("t").agg(*[F.bit_or(f"d{k}").alias(f"r{k}") for k in range(words)])
        got = [F.coalesce(f"r{k}", F.lit(0).cast("bigint")) for k in range(words)]
        nxt = state.join(met, F.col("v") == F.col("t"), "left").select(
            "v", "slot", *[F.col(f"w{k}").bitwiseOR(got[k]).alias(f"w{k}") for k in range(words)],
            *[got[k].bitwiseAND(F.bitwise_not(f"w{k}")).alias(f"d{k}") for k in range(words)])
        state = scratch.write(f"{name}-{step}", nxt)
        scratch.remove(f"{name}-{step - 1}")
    return state


def telling(scratch: Scratch, nodes: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """Edges of a graph without cycles, those left out that a path over a hub replaces. Hubs are the heaviest
    nodes (v, n); with every replaced edge out, the paths that replace it remain."""
    rank = F.row_number().over(W.orderBy(F.desc("n"), "v")) - 1
    hubs = scratch.write("hubs", nodes.filter("n > 1").orderBy(F.desc("n"), "v").limit(64 * words).select("v", rank.alias("slot")))
    if hubs.isEmpty():
        return pairs
    slots = nodes.select("v").join(hubs, "v", "left")

    def others(name: str, edges: DataFrame, end: str, as_: str) -> DataFrame:
        hit = reached(scratch, name, slots, edges, words)
        own = _bits(F.col("slot"), words)
        return hit.select(F.col("v").alias(end), *[F.col(f"w{k}").bitwiseAND(F.bitwise_not(own[k])).alias(f"{as_}{k}") for k in range(words)])

    after, before = others("hubs-after", turned(pairs), "s", "a"), others("hubs-before", pairs, "t", "b")
    met = " or ".join(f"(a{k} & b{k}) <> 0" for k in range(words))
    return scratch.write("telling", pairs.join(after, "s").join(before, "t").filter(f"not ({met})").select("s", "t"))


def weigh(scratch: Scratch, block: int, state: DataFrame, words: int) -> DataFrame:
    """kind, v, n for the states (v, slot, up, down, words) of a block: `up` weight each start has reached,
    `down` weight of the starts that have reached each node."""
    starts = {r["slot"]: (r["v"], r["down"]) for r in state.filter("slot is not null").select("slot", "v", "down").collect()}
    at = np.array([starts[k][0] for k in range(len(starts))], np.int64)
    down = np.zeros(64 * words)
    down[:len(starts)] = [starts[k][1] for k in range(len(starts))]

    def run(batches):
        total = np.zeros(64 * words)
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                b = whole.slice(low, 1024)
                words_of = np.stack([b.column(f"w{k}").to_numpy() for k in range(words)], axis=1).view(np.uint8).reshape(b.num_rows, -1)
                bits = np.unpackbits(words_of, axis=1, bitorder="little").astype(np.float64)
                total += b.column("up").to_numpy().astype(np.float64) @ bits
                n = (bits @ down).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(["down"] * len(n)), b.column("v"), pa.array(n)], ["kind", "v", "n"])
        seen = np.flatnonzero(total[:len(at)])
        yield pa.RecordBatch.from_arrays([pa.array(["up"] * len(seen), pa.string()), pa.array(at[seen]), pa.array(total[seen].astype(np.int64))], ["kind", "v", "n"])

    counts = state.select("v", "up", *[f"w{k}" for k in range(words)]).mapInArrow(run, "kind string, v bigint, n bigint")
    return scratch.write(f"weights-{block}", counts.groupBy("kind", "v").agg(F.sum("n").alias("n")))


def searched(scratch: Scratch, nodes: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """v, n_up, n_down of the nodes (v, up, down), by searches from all of them that have edges."""
    linked = nodes.join(degrees(pairs).select("v"), "v", "left_semi")
    alone = nodes.join(degrees(pairs).select("v"), "v", "left_anti").select("v", F.col("up").alias("n_up"), F.col("down").alias("n_down"))
    placed = scratch.write("placed", with_row_index(linked, [F.col("v")], "i"))
    size = 64 * words
    parts = None
    for block in range(-(-placed.count() // size)):
        slot = F.when(F.floor(F.col("i") / size) == block, F.pmod(F.col("i"), F.lit(size))).cast("int")
        state = reached(scratch, f"block-{block}", placed.select("v", slot.alias("slot")), pairs, words)
        part = weigh(scratch, block, state.join(placed.select("v", "up", "down"), "v"), words)
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return alone
    total = [F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(f"n_{k}") for k in ("up", "down")]
    return alone.unionByName(parts.groupBy("v").agg(*total))


# --- folding ----------------------------------------------------------------------------------------


def folded(scratch: Scratch, nodes: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Nodes and edges that are left, and the rounds of nodes (v, up, down, into, last) that were folded into
    their only neighbour: `last` ones have one edge in and none out, others one edge out and none in."""
    rounds, idle = [], 0
    for n in range(FOLDS):
        last = n % 2 == 0
        few = scratch.write(f"few-{n}", degrees(pairs).filter("n_in = 1 and n_out = 0" if last else "n_out = 1 and n_in = 0").select("v"))
        if few.isEmpty():
            idle += 1
            if idle == 2:
                break
            continue
        idle = 0
        mine, other = ("t", "s") if last else ("s", "t")
        gone = scratch.write(f"gone-{n}", few.join(pairs.select(F.col(mine).alias("v"), F.col(other).alias("into")), "v")
                             .join(nodes, "v").select("v", "up", "down", "into", F.lit(last).alias("last")))
        more = gone.groupBy(F.col("into").alias("v")).agg(F.sum("up" if last else "down").alias("more"))
        grown = {c: F.col(c) + F.coalesce("more", F.lit(0)) if (c == "up") == last else F.col(c) for c in ("up", "down")}
        nodes = scratch.write(f"kept-{n}", nodes.join(few, "v", "left_anti").join(more, "v", "left").select("v", *[x.alias(c) for c, x in grown.items()]))
        pairs = scratch.write(f"edges-{n}", pairs.join(few, pairs[mine] == few["v"], "left_anti"))
        rounds.append(gone)
    return nodes, pairs, rounds


def unfolded(scratch: Scratch, found: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """v, n_up, n_down with the folded nodes among them, from the last round to the first."""
    for n, gone in reversed(list(enumerate(rounds))):
        into = found.select(F.col("v").alias("into"), "n_up", "n_down")
        back = gone.join(into, "into").select(
            "v", F.when(F.col("last"), F.col("up")).otherwise(F.col("n_up") + F.col("up")).alias("n_up"),
            F.when(F.col("last"), F.col("n_down") + F.col("down")).otherwise(F.col("down")).alias("n_down"))
        found = scratch.write(f"unfolded-{n}", found.unionByName(back))
    return found


# --- in memory --------------------------------------------------------------------------------------


def packed(sized: DataFrame, links: DataFrame) -> DataFrame:
    """v, n_up, n_down of the nodes (v, n) of a graph without cycles whose edges the driver can hold."""
    spark = sized.sparkSession
    s, t = held(links)
    names, both = np.unique(np.concatenate([s, t]), return_inverse=True)
    linked = links.select(F.col("s").alias("v")).unionByName(links.select(F.col("t").alias("v"))).distinct()
    v, n = held(sized.join(linked, "v", "left_semi").select("v", "n"))
    weight = np.empty(len(names), np.int64)
    weight[np.searchsorted(names, v)] = n
    s, t, w_up, w_down, rounds = reach.fold(len(names), both[:len(s)], both[len(s):], weight)
    left = reach.pieces(len(names), s, t, w_up, w_down)
    up, down, blocks = left.add_up, left.add_down, left.blocks()
    if blocks:
        sent = spark.sparkContext.broadcast((left, blocks))

        def run(batches):
            (left, blocks), orders, sums = sent.value, {}, {}
            for i in (int(i) for b in batches for i in b.column("id").to_numpy()):
                bundle = blocks[i][0]
                v_up, n_up, v_down, n_down = reach.answer(left, *blocks[i], orders)
                if bundle in sums:
                    sums[bundle][1] += n_up
                    sums[bundle][3] += n_down
                    continue
                for got in sums.values():
                    yield from rows(got)
                sums = {bundle: [v_up, n_up, v_down, n_down]}
            for got in sums.values():
                yield from rows(got)

        def rows(got):
            for up, v, n in ((True, *got[:2]), (False, *got[2:])):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), up)), pa.array(v), pa.array(n)], ["up", "v", "n"])

        tasks = spark.range(0, len(blocks), 1, min(len(blocks), 8 * spark.sparkContext.defaultParallelism))
        sums = tasks.mapInArrow(run, "up boolean, v bigint, n bigint").groupBy("up", "v").agg(F.sum("n").alias("n"))
        at_up, at, n = held(sums)
        at_up = at_up.astype(bool)
        up[at[at_up]] += n[at_up]
        down[at[~at_up]] += n[~at_up]
        sent.destroy()
    reach.unfold(up, down, w_up, w_down, rounds)
    if not len(names):
        return sized.select("v", F.col("n").alias("n_up"), F.col("n").alias("n_down"))
    found = spark.createDataFrame(pa.table({"v": names, "n_up": up, "n_down": down}))
    return sized.join(found, "v", "left").select("v", F.coalesce("n_up", "n").alias("n_up"), F.coalesce("n_down", "n").alias("n_down"))


def closure_counts(edges: DataFrame, words: int = 32) -> DataFrame:
    """id, n_ancestors, n_descendants of every node of the edges (src, dst), itself not counted."""
    scratch = Scratch(edges.sparkSession)
    edges = scratch.write("given", edges.select("src", "dst"))  # nodes and pairs read it
    nodes, pairs = numbered(scratch, edges)
    n = nodes.count()
    if n <= NUMBERS:
        pairs = strips(scratch, pairs)
        scratch.remove("given")
        comp, acyclic = labelled(scratch, pairs, n)
        of, links = contracted(scratch, nodes, pairs, comp)
    else:
        pairs = scratch.write("pairs", pairs)
        scratch.remove("given")
        moved, acyclic = components(scratch, pairs)
        moved = nodes.select("v", F.col("v").alias("c")).limit(0) if moved is None else moved
        names = scratch.write("names", nodes.join(moved, "v", "left").select("id", "v", F.coalesce("c", "v").alias("c")))
        ends = pairs.join(names.select(F.col("v").alias("s"), F.col("c").alias("cs")), "s").join(
            names.select(F.col("v").alias("t"), F.col("c").alias("ct")), "t")
        of = names.select("id", "c")
        links = scratch.write("links", ends.filter("cs <> ct").select(F.col("cs").alias("s"), F.col("ct").alias("t")).distinct())
    sized = scratch.write("sized", of.groupBy(F.col("c").alias("v")).agg(F.count("*").alias("n")))
    if acyclic and links.count() <= HELD:
        sums = packed(sized, links)
    else:
        if acyclic:
            links = telling(scratch, sized, links, words)
        weighed = sized.select("v", F.col("n").alias("up"), F.col("n").alias("down"))
        kept, left, rounds = folded(scratch, weighed, links)
        sums = unfolded(scratch, searched(scratch, kept, left, words), rounds)
    return of.join(sums.withColumnRenamed("v", "c"), "c").select("id", (F.col("n_up") - 1).alias("n_ancestors"), (F.col("n_down") - 1).alias("n_descendants"))
