"""Leiden community detection (Traag, Waltman and van Eck, 2019) by modularity, for one connected component at a time.

Components do not share edges, so with the whole graph's total weight in the null model each can be
worked on by itself, one task a component. Order and ties are fixed by a seed and by node order.
"""

from __future__ import annotations

import random

import pyarrow as pa


def _move(near, strength, group, total, resolution, order):
    """Local moves until no node gains: nodes whose neighbourhood changed are looked at again."""
    mass: dict[int, float] = {}
    for v, g in enumerate(group):
        mass[g] = mass.get(g, 0.0) + strength[v]
    queue, waiting, moved = list(order), set(order), False
    head = 0
    while head < len(queue):
        v = queue[head]
        head += 1
        waiting.discard(v)
        links: dict[int, float] = {}
        for u, w in near[v].items():
            if u != v:
                links[group[u]] = links.get(group[u], 0.0) + w
        own = group[v]
        mass[own] -= strength[v]
        gain = lambda g: links.get(g, 0.0) - resolution * strength[v] * mass.get(g, 0.0) / total
        best, value = own, gain(own)
        for g in sorted(links):
            if gain(g) > value + 1e-12:
                best, value = g, gain(g)
        if value < -1e-12:  # alone is better
            best = max(mass) + 1
        mass[best] = mass.get(best, 0.0) + strength[v]
        if best != own:
            group[v], moved = best, True
            for u in near[v]:
                if group[u] != best and u not in waiting:
                    waiting.add(u)
                    queue.append(u)
    return moved


def _refine(near, strength, group, total, resolution, order):
    """Inside each group, merge single nodes that hang well together with it; groups may come apart, never disconnected."""
    part, mass, outside = list(range(len(near))), list(strength), [0.0] * len(near)
    whole: dict[int, float] = {}
    for v, g in enumerate(group):
        whole[g] = whole.get(g, 0.0) + strength[v]
        outside[v] = sum(w for u, w in near[v].items() if u != v and group[u] == g)  # weight from the part to the rest of its group
    size = [1] * len(near)
    for v in order:
        g = group[v]
        if size[part[v]] != 1 or outside[part[v]] < resolution * strength[v] * (whole[g] - strength[v]) / total - 1e-12:
            continue
        links: dict[int, float] = {}
        for u, w in near[v].items():
            if u != v and group[u] == g:
                links[part[u]] = links.get(part[u], 0.0) + w
        best, value = part[v], 0.0
        for p in sorted(links):
            fit = outside[p] >= resolution * mass[p] * (whole[g] - mass[p]) / total - 1e-12
            gain = links[p] - resolution * strength[v] * mass[p] / total
            if fit and gain > value + 1e-12:
                best, value = p, gain
        if best != part[v]:
            old = part[v]
            size[old] -= 1
            size[best] += 1
            outside[best] += outside[old] - 2 * links[best]
            mass[best] += strength[v]
            mass[old], outside[old], part[v] = 0.0, 0.0, best
    return part


def leiden(near: list[dict[int, float]], total: float | None = None, resolution: float = 1.0, iterations: int = 2, seed: int = 0) -> list[int]:
    """Group of every node. near: weights by neighbour, both ways, a self loop counted twice; total: twice the weight of all edges of the whole graph."""
    base = [sum(n.values()) for n in near]
    total = total or sum(base) or 1.0
    group, rng = list(range(len(near))), random.Random(seed)
    for _ in range(iterations):
        level, strength, inside = near, base, list(range(len(near)))  # inside: level node of every node
        own, changed = list(group), False
        while True:
            order = list(range(len(level)))
            rng.shuffle(order)
            changed |= _move(level, strength, own, total, resolution, order)
            if len(set(own)) == len(level):
                break
            part = _refine(level, strength, own, total, resolution, order)
            ids = {p: k for k, p in enumerate(dict.fromkeys(part))}
            part = [ids[p] for p in part]
            if len(ids) == len(level):
                break
            fresh: list[dict[int, float]] = [{} for _ in ids]
            weight, upper = [0.0] * len(ids), [0] * len(ids)
            for v, p in enumerate(part):
                weight[p] += strength[v]
                upper[p] = own[v]
                for u, w in level[v].items():
                    fresh[p][part[u]] = fresh[p].get(part[u], 0.0) + w
            level, strength, own = fresh, weight, upper
            inside = [part[k] for k in inside]
        group = [own[k] for k in inside]
        if not changed:
            break
    return group


def in_component(table: pa.Table, total: float, resolution: float, iterations: int) -> pa.Table:
    """node, label of one component's edges (node, other); a community is labelled by its smallest node."""
    names = sorted(set(table.column("node").to_pylist()))
    at = {n: k for k, n in enumerate(names)}
    near: list[dict[int, float]] = [{} for _ in names]
    for a, b in zip(table.column("node").to_pylist(), table.column("other").to_pylist(), strict=True):
        if a != b:
            near[at[a]][at[b]] = 1.0
    group = leiden(near, total, resolution, iterations)
    first: dict[int, object] = {}
    for k, g in enumerate(group):
        first.setdefault(g, names[k])
    kind = table.schema.field("node").type
    return pa.table({"node": pa.array(names, kind), "label": pa.array([first[g] for g in group], kind)})
