"""Closure weights in a graph of numbered nodes that fits one machine's memory: arrays (n nodes, edges s -> t).

Nothing here looks for a closure node by node. Cycles are found by Tarjan's walk. Nodes with one neighbour are
folded into it until none is left. A connected piece that is still large is split at a hub h, exactly: a node
that reaches h reaches what h does and, besides, only what h does not reach; a node that does not reach h
never meets one that does. So the nodes h does not reach (`before`) and those that do not reach h (`behind`) are
pieces of their own without h, what h says is a number added to each node, and only nodes unrelated to h stand in
both: one copy is asked for its weight upwards, the other downwards. Pieces are then swept in topological
order, sets of 64 nodes in a number, and counted by the bits of their weights."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PIECE = 4096       # nodes that are swept at once
FOLDS = 1 << 14    # rounds of folding
SPLITS = 16        # rounds of splitting; pieces that are still large are swept in blocks of bits
WORDS = 1 << 22    # numbers in the sets of a sweep, unless one for each node is more


def offsets(n: int, ends: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(ends, minlength=n))])


def strong(n: int, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The component of each node, named by one of its nodes."""
    comp = np.arange(n, dtype=np.int64)
    nodes, both = np.unique(np.concatenate([s, t]), return_inverse=True)
    s, t = both[:len(s)], both[len(s):]
    at, to = offsets(len(nodes), s).tolist(), t[np.argsort(s, kind="stable")].tolist()
    index, low, done = [0] * len(nodes), [0] * len(nodes), [False] * len(nodes)
    nxt, stack, count, own = at[:-1], [], 0, list(range(len(nodes)))
    for root in range(len(nodes)):
        if index[root]:
            continue
        path = [root]
        while path:
            v = path[-1]
            if not index[v]:
                count += 1
                index[v] = low[v] = count
                stack.append(v)
            k, end, least = nxt[v], at[v + 1], low[v]
            while k < end:
                x = to[k]
                if not index[x]:
                    break
                if not done[x] and low[x] < least:
                    least = low[x]
                k += 1
            low[v], nxt[v] = least, k
            if k < end:  # comes back to this edge when its target is done
                path.append(to[k])
                continue
            path.pop()
            if least == index[v]:
                while True:
                    x = stack.pop()
                    done[x], own[x] = True, v
                    if x == v:
                        break
    comp[nodes] = nodes[np.array(own, np.int64)] if len(nodes) else nodes
    return comp


def fold(n: int, s: np.ndarray, t: np.ndarray, weight: np.ndarray):
    """Edges that are left, weights upwards and downwards, and rounds (v, into, sink) of nodes folded into their only neighbour."""
    outs, ins, up, down = np.bincount(s, minlength=n), np.bincount(t, minlength=n), weight.copy(), weight.copy()
    to, of = np.zeros(n, np.int64), np.zeros(n, np.int64)  # of a node with one neighbour, that neighbour
    np.bitwise_xor.at(to, s, t)
    np.bitwise_xor.at(of, t, s)
    ready, rounds, kept = np.flatnonzero(outs + ins == 1), [], np.ones(n, bool)
    while len(ready) and len(rounds) < FOLDS:
        sink = ins[ready] == 1
        into = np.where(sink, of[ready], to[ready])
        alone = sink | (outs[into] + ins[into] > 1)  # of two nodes that have only each other, the sink goes
        v, u, sink = ready[alone], into[alone], sink[alone]
        for w, mine, less, other in ((up, sink, outs, to), (down, ~sink, ins, of)):
            np.add.at(w, u[mine], w[v[mine]])
            np.subtract.at(less, u[mine], 1)
            np.bitwise_xor.at(other, u[mine], v[mine])
        outs[v], ins[v], kept[v] = 0, 0, False
        rounds.append((v, u, sink))
        near = np.unique(u)
        ready = near[outs[near] + ins[near] == 1]
    held = kept[s] & kept[t]
    return s[held], t[held], up, down, rounds


def unfold(up: np.ndarray, down: np.ndarray, w_up: np.ndarray, w_down: np.ndarray, rounds: list) -> None:
    """Fills in the closure weights of the folded nodes, from the last round to the first."""
    for v, u, sink in reversed(rounds):
        up[v] = np.where(sink, 0, up[u]) + w_up[v]
        down[v] = np.where(sink, down[u], 0) + w_down[v]


def connected(n: int, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """A name for the connected piece of each node, whatever the direction of the edges."""
    name = np.arange(n)
    while True:
        a, b = name[s], name[t]
        apart = a != b
        if not apart.any():
            return name
        s, t = s[apart], t[apart]
        np.minimum.at(name, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (name[name] != name).any():
            name = name[name]


def flooded(n: int, s: np.ndarray, t: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which nodes the starts reach, themselves among them."""
    at, to = offsets(n, s), t[np.argsort(s, kind="stable")]
    hit = np.zeros(n, bool)
    hit[starts] = True
    while len(starts):
        first, many = at[starts], at[starts + 1] - at[starts]
        ends = np.cumsum(many)
        met = to[np.arange(many.sum()) + np.repeat(first - ends + many, many)]
        starts = np.unique(met[~hit[met]])
        hit[starts] = True
    return hit


@dataclass
class Pieces:
    """What is left to be swept: nodes in bundles of whole pieces, one after the other, and edges in the same order."""
    v: np.ndarray         # the node each stands for
    s: np.ndarray
    t: np.ndarray
    w_up: np.ndarray
    w_down: np.ndarray
    up: np.ndarray        # whether it is asked for its weight upwards
    down: np.ndarray
    nodes_at: np.ndarray  # where a bundle begins
    edges_at: np.ndarray
    add_up: np.ndarray    # what hubs say, for each of the n nodes
    add_down: np.ndarray

    def blocks(self) -> list[tuple[int, int, int]]:
        """bundle, first and last node of the sets of each sweep."""
        out = []
        for k, n in enumerate(np.diff(self.nodes_at).tolist()):
            size = 64 * max(1, min(-(-n // 64), WORDS // n))
            out += [(k, low, min(low + size, n)) for low in range(0, n, size)]
        return out


def pieces(n: int, s: np.ndarray, t: np.ndarray, w_up: np.ndarray, w_down: np.ndarray, size: int | None = None) -> Pieces:
    """Splits a graph without cycles; nodes without edges are answered by `add_up` and `add_down`."""
    size = size or PIECE
    add_up, add_down = np.zeros(n, np.int64), np.zeros(n, np.int64)
    v, up, down, stuck = np.arange(n), np.ones(n, bool), np.ones(n, bool), np.zeros(n, bool)
    for step in range(SPLITS + 1):
        # a node without edges has its own weight
        outs, ins = np.bincount(s, minlength=len(v)), np.bincount(t, minlength=len(v))
        lone = outs + ins == 0
        for add, w, asked in ((add_up, w_up, up), (add_down, w_down, down)):
            add[v[lone & asked]] += w[v[lone & asked]]
        name = connected(len(v), s, t)
        # in a piece without paths of two edges, edges say all
        inner = np.zeros(len(v), np.int64)
        np.maximum.at(inner, name, (outs > 0) & (ins > 0))
        flat = ~inner[name].astype(bool) & ~lone
        for add, w, asked, a, b in ((add_up, w_up, up, s, t), (add_down, w_down, down, t, s)):
            e = flat[a]
            total = w[v].copy()
            np.add.at(total, a[e], w[v[b[e]]])
            add[v[flat & asked]] += total[flat & asked]
        many = np.bincount(name, minlength=len(v))[name]
        wide = (many > size) & ~flat & ~stuck
        keep = ~(lone | flat | wide)
        copies = [(keep, up, down)]
        if step < SPLITS and wide.any():
            at = np.flatnonzero(wide)
            order = at[np.lexsort((outs[at].astype(np.float64) * ins[at], name[at]))]
            hubs = order[np.append(name[order][1:] != name[order][:-1], True)]
            hub_of = np.zeros(len(v), np.int64)
            hub_of[name[hubs]] = hubs
            h = hub_of[name]
            after, before = flooded(len(v), s, t, hubs), flooded(len(v), t, s, hubs)
            alien = np.bincount(name[wide & ~after & ~before], minlength=len(v))[name]
            split = wide & (2 * alien <= many)
            stuck |= wide & ~split
            copies = [(keep | (wide & ~split), up, down)]
            sum_up, sum_down = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
            np.add.at(sum_up, h[split & after], w_up[v[split & after]])
            np.add.at(sum_down, h[split & before], w_down[v[split & before]])
            for add, total, asked in ((add_up, sum_up, split & before & up), (add_down, sum_down, split & after & down)):
                add[v[asked]] += total[h[asked]]
            # a node unrelated to the hub is asked downwards before it and upwards behind it
            copies += [(split & ~after, up & before, down), (split & ~before, up, down & after)]
        elif wide.any():
            copies = [(keep | wide, up, down)]
        parts, base = [], 0
        for k, (mask, asked_up, asked_down) in enumerate(copies):
            new = np.cumsum(mask) - 1 + base
            e = mask[s] & mask[t]
            parts.append((v[mask], new[s[e]], new[t[e]], asked_up[mask], asked_down[mask], stuck[mask] & (k == 0)))
            base += int(mask.sum())
        done = len(copies) == 1
        v, s, t, up, down, stuck = (np.concatenate(x) for x in zip(*parts))
        if done:
            break
    name = connected(len(v), s, t)
    order = np.lexsort((name, np.bincount(name, minlength=len(v))[name]))
    new = np.empty(len(v), np.int64)
    new[order] = np.arange(len(v))
    name, v, up, down = name[order], v[order], up[order], down[order]
    first = np.append(True, name[1:] != name[:-1]) if len(v) else np.zeros(0, bool)
    begin = np.flatnonzero(first)                   # of each piece
    begin = begin[np.append(True, begin[1:] // size != begin[:-1] // size)] if len(begin) else begin
    s, t = new[s], new[t]
    bundle = np.searchsorted(begin, s, "right")
    by = np.argsort(bundle, kind="stable")
    return Pieces(v, s[by], t[by], w_up[v], w_down[v], up, down, np.append(begin, len(v)),
                  np.searchsorted(bundle[by], np.arange(1, len(begin) + 2)), add_up, add_down)


def levels(n: int, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Edges of the longest path from each node of a graph without cycles."""
    level, left = np.zeros(n, np.int64), np.bincount(s, minlength=n)
    at, of = offsets(n, t), s[np.argsort(t, kind="stable")]
    ready, k = np.flatnonzero(left == 0), 0
    while len(ready):
        level[ready] = k
        first, many = at[ready], at[ready + 1] - at[ready]
        ends = np.cumsum(many)
        met, times = np.unique(of[np.arange(many.sum()) + np.repeat(first - ends + many, many)], return_counts=True)
        left[met] -= times
        ready, k = met[left[met] == 0], k + 1
    return level


def swept(n: int, s: np.ndarray, t: np.ndarray, weight: np.ndarray, low: int, high: int, order: np.ndarray) -> np.ndarray:
    """Of each node, the weight of those nodes low <= x < high that it reaches."""
    words, x = -(-(high - low) // 64), np.arange(high - low)
    sets = np.zeros((n, words), np.uint64)
    sets[low + x, x // 64] = np.uint64(1) << (x % 64).astype(np.uint64)
    by = np.lexsort((s, order[s]))
    s, t = s[by], t[by]
    heads = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    ends = np.append(heads, len(s))
    nodes = s[heads]
    steps = np.flatnonzero(np.append(True, order[nodes][1:] != order[nodes][:-1])) if len(nodes) else []
    for a, b in zip(steps, np.append(steps[1:], len(nodes))):
        e = slice(ends[a], ends[b])
        sets[nodes[a:b]] |= np.bitwise_or.reduceat(sets[t[e]], heads[a:b] - ends[a], axis=0)
    total, here = np.zeros(n, np.int64), weight[low:high]
    for k in range(int(here.max()).bit_length()):
        mask = np.zeros(64 * words, np.uint8)
        mask[:high - low] = (here >> k) & 1
        if mask.any():
            mask = np.packbits(mask, bitorder="little").view(np.uint64)
            total += np.bitwise_count(sets & mask).sum(axis=1, dtype=np.int64) << k
    return total


def answer(p: Pieces, bundle: int, low: int, high: int, orders: dict) -> tuple[np.ndarray, ...]:
    """Nodes asked upwards and their weights, nodes asked downwards and theirs, from one sweep each. The order
    of the bundle is kept in `orders` for its next block."""
    a, b, e = p.nodes_at[bundle], p.nodes_at[bundle + 1], slice(p.edges_at[bundle], p.edges_at[bundle + 1])
    s, t, n = p.s[e] - a, p.t[e] - a, b - a
    up, down = p.up[a:b], p.down[a:b]
    if bundle not in orders:
        orders.clear()
        orders[bundle] = levels(n, s, t), levels(n, t, s)
    got = []
    for asked, x, y, w, order in ((up, s, t, p.w_up[a:b], orders[bundle][0]), (down, t, s, p.w_down[a:b], orders[bundle][1])):
        got += [p.v[a:b][asked], swept(n, x, y, w, low, high, order)[asked]]
    return tuple(got)
