"""Hierarchical navigable small-world graphs over unit vectors, built and searched in slices with numpy."""

from __future__ import annotations

import numpy as np

#: Links of a node (twice as many on the lowest layer), nearest nodes among which each is chosen, nodes of the top layer at
#: most, most rows that are searched at once.
LINKS, CANDIDATES, TOP, BATCH = 12, 3, 48, 256
#: Nodes of the layer above from which a search starts: one alone may lie in another dense cluster, wider than the beam.
ENTRIES = 8
#: A node has a link from one of so many of its nearest ones at least.
NEAREST = 6


class Graph:
    """layers[0] is the lowest and holds all nodes; a node reaches layer l with probability LINKS ** -l. Each layer has
    its nodes and, for each, links to others (places in the layer; -1: none)."""

    def __init__(self, vectors: np.ndarray, seed: int = 1):
        self.vectors = np.ascontiguousarray(vectors, dtype=np.float32)
        n = len(vectors)
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(np.maximum(rng.random(n), 1e-300)) / np.log(LINKS)).astype(int)
        self.nodes: list[np.ndarray] = [np.arange(n)]
        while len(self.nodes[-1]) > TOP:
            above = self.nodes[-1][level[self.nodes[-1]] >= len(self.nodes)]
            if len(above) in (0, len(self.nodes[-1])):
                above = self.nodes[-1][:: LINKS]
            self.nodes.append(above)
        self.links: list[np.ndarray] = [np.zeros((0, 0), dtype=np.int32)] * len(self.nodes)
        for layer in range(len(self.nodes) - 1, -1, -1):
            self._build(layer)

    def _build(self, layer: int) -> None:
        """Each node of a layer is linked to near ones that aren't nearer to a link chosen before, and back. A graph is no
        larger than a task may hold, so a node's nearest ones come from products of slices of the layer with all of it,
        which take far less time than searches, and miss none."""
        own = self.nodes[layer]
        n, most = len(own), LINKS * (2 if layer == 0 else 1)
        links = np.full((n, most), -1, dtype=np.int32)
        vecs = self.vectors[own]
        up = np.isin(own, self.nodes[layer + 1]) if layer + 1 < len(self.nodes) else np.zeros(n, dtype=bool)
        found, sims = [], []
        for a in range(0, n, BATCH):
            near = vecs[a : a + BATCH] @ vecs.T
            near[np.arange(len(near)), np.arange(a, a + len(near))] = -2
            k = min(n, CANDIDATES * most)
            best = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (len(near), 1))
            found.append(best)
            sims.append(np.take_along_axis(near, best, 1))
        _link_found(vecs, links, np.arange(n), np.concatenate(found), np.concatenate(sims), most)
        self.links[layer] = _reached(vecs, links, np.flatnonzero(up) if up.any() else np.arange(min(n, 1)))

    def _descend(self, queries: np.ndarray, layer: int) -> np.ndarray:
        """Places in a layer to start from, some for each query (-1 fills up): the nearest nodes of the layer above, which
        are reached from the top."""
        top = len(self.nodes) - 1
        if layer >= top:
            return np.zeros((len(queries), 1), dtype=np.int64)
        sims = queries @ self.vectors[self.nodes[top]].T
        best = np.argsort(-sims, axis=1)[:, :ENTRIES]
        for at in range(top - 1, layer, -1):
            start = np.searchsorted(self.nodes[at], self.nodes[at + 1][best])
            start = np.where(best < 0, -1, start)
            best = _beam(self.vectors[self.nodes[at]], self.links[at], queries, start, 2 * ENTRIES)[0][:, :ENTRIES]
        place = np.searchsorted(self.nodes[layer], self.nodes[layer + 1][best])
        return np.where(best < 0, -1, place)

    def search(self, queries: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, similarity) of nodes with at least that similarity which a beam of that width finds, and those
        that are reached from them over links of nodes at least that similar."""
        q, v = [], []
        queries = np.ascontiguousarray(queries, dtype=np.float32)
        for a in range(0, len(queries), BATCH):
            part = queries[a : a + BATCH]
            _, _, who, what = _beam(self.vectors, self.links[0], part, self._descend(part, 0), beam, least)
            q.append(who + a)
            v.append(what)
        q, v = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (q, v))
        sims = np.einsum("ij,ij->i", queries[q], self.vectors[v]) if len(q) else np.zeros(0, dtype=np.float32)
        return q, v, sims


def _link_found(vecs: np.ndarray, links: np.ndarray, who: np.ndarray, found: np.ndarray, sims: np.ndarray, most: int) -> None:
    order = np.argsort(-sims, axis=1)
    found, sims = np.take_along_axis(found, order, 1), np.take_along_axis(sims, order, 1)
    back: dict[int, list[int]] = {}
    for k, node in enumerate(who):
        ok = (found[k] >= 0) & (found[k] != node) & (sims[k] > -1.5)
        near, first = np.unique(found[k][ok], return_index=True)
        near = near[np.argsort(first)]
        mine = _choose(vecs, int(node), near, most)
        links[node, : len(mine)] = mine
        links[node, len(mine) :] = -1
        for other in mine:
            back.setdefault(int(other), []).append(int(node))
    for node, more in back.items():
        have = links[node][links[node] >= 0]
        every = np.unique(np.r_[have, np.array(more, dtype=have.dtype)])
        if len(every) > most:
            every = every[np.argsort(-(vecs[every] @ vecs[node]), kind="stable")]
            every = _choose(vecs, node, every, most)
        links[node, : len(every)] = every
        links[node, len(every) :] = -1


def _reached(vecs: np.ndarray, links: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """links with further ones: to each node that none of its nearest ones links to, from the nearest one; and to each node
    that can't be reached from seeds, from the nearest one that can."""
    n = len(vecs)
    seen = np.zeros(n, dtype=bool)
    extra: dict[int, list[int]] = {}
    own = np.where(links >= 0, np.einsum("ij,ikj->ik", vecs, vecs[links]), -3)
    near = np.take_along_axis(links, np.argsort(-own, axis=1, kind="stable")[:, :NEAREST], 1)
    back = ((links[near] == np.arange(n)[:, None, None]) & (near >= 0)[:, :, None]).any(axis=(1, 2))
    for a in np.flatnonzero(~back & (near[:, 0] >= 0)).tolist():
        extra.setdefault(int(near[a, 0]), []).append(a)
    front = seeds
    while True:
        while len(front):
            seen[front] = True
            to = np.unique(links[front])
            to = to[to >= 0]
            front = to[~seen[to]]
        lost = np.flatnonzero(~seen)
        if not len(lost):
            break
        known = np.flatnonzero(seen)
        part = lost[:BATCH]
        near = known[np.argmax(vecs[part] @ vecs[known].T, axis=1)]
        for a, b in zip(near.tolist(), part.tolist(), strict=True):
            extra.setdefault(a, []).append(b)
        front = part
    wide = max((len(x) for x in extra.values()), default=0)
    more = np.full((n, wide), -1, dtype=links.dtype)
    for a, to in extra.items():
        more[a, : len(to)] = to
    return np.c_[links, more] if wide else links


def _choose(vecs: np.ndarray, node: int, near: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` of near (nearest first): those not nearer to a chosen one than to the node, then the nearest others."""
    if len(near) <= most // 2:
        return near
    near = near[: 3 * most]
    own = vecs[near] @ vecs[node]
    between = vecs[near] @ vecs[near].T
    kept: list[int] = []
    for k in range(len(near)):
        if len(kept) == most:
            break
        if not kept or between[k, kept].max() < own[k]:
            kept.append(k)
    rest = [k for k in range(len(near)) if k not in set(kept)]
    return near[sorted(kept + rest[: most - len(kept)])]


def _beam(
    vecs: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int, least: float = 2.0
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The `width` nearest nodes that each query finds from its entries (-1 fills up), their similarities, and (query, node)
    of all that it met with at least `least`. Each step opens every query's nearest node that isn't open yet, as long as
    one of its beam or one with at least `least` is left."""
    m, n = len(queries), len(vecs)
    width = min(width, n)
    seen = np.zeros((m, n), dtype=bool)
    rows = np.arange(m)
    ids = np.full((m, width), -1, dtype=np.int64)
    sims = np.full((m, width), -3, dtype=np.float32)
    opened = np.zeros((m, width), dtype=bool)
    entry = entries[:, :width]
    begin = np.where(entry >= 0, np.einsum("ij,ikj->ik", queries, vecs[entry]), -3)
    order = np.argsort(-begin, axis=1, kind="stable")
    k = entry.shape[1]
    ids[:, :k], sims[:, :k] = np.take_along_axis(entry, order, 1), np.take_along_axis(begin, order, 1)
    r, c = np.nonzero(entry >= 0)
    seen[r, entry[r, c]] = True
    r, c = np.nonzero(begin >= least)
    hit_q, hit_v = [r], [entry[r, c]]

    def meet(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unseen links of nodes v for queries q, with similarities; each (query, node) once."""
        to = links[v]
        qq = np.repeat(q, to.shape[1])
        to = to.ravel()
        ok = to >= 0
        qq, to = qq[ok], to[ok]
        new = ~seen[qq, to]
        qq, to = qq[new], to[new]
        if len(qq):
            _, first = np.unique(qq * n + to, return_index=True)
            qq, to = qq[first], to[first]
            seen[qq, to] = True
        return qq, to, np.einsum("ij,ij->i", queries[qq], vecs[to]) if len(qq) else np.zeros(0, dtype=np.float32)

    while True:
        best = np.where(opened | (ids < 0), -4, sims)
        pick = best.argmax(axis=1)
        live = np.flatnonzero(best[rows, pick] > -3.5)
        if not len(live):
            break
        opened[live, pick[live]] = True
        q, v, s = meet(live, ids[live, pick[live]])
        if not len(q):
            continue
        hit = s >= least
        hit_q.append(q[hit])
        hit_v.append(v[hit])
        # rows of equal length to merge into the beams
        count = np.bincount(q, minlength=m)
        k = int(count.max())
        place = np.arange(len(q)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
        more_i = np.full((m, k), -1, dtype=np.int64)
        more_s = np.full((m, k), -3, dtype=np.float32)
        more_i[q, place] = v
        more_s[q, place] = s
        touched = np.flatnonzero(count)
        all_i = np.c_[ids[touched], more_i[touched]]
        all_s = np.c_[sims[touched], more_s[touched]]
        all_o = np.c_[opened[touched], np.zeros((len(touched), k), dtype=bool)]
        order = np.argsort(-all_s, axis=1, kind="stable")[:, :width]
        ids[touched] = np.take_along_axis(all_i, order, 1)
        sims[touched] = np.take_along_axis(all_s, order, 1)
        opened[touched] = np.take_along_axis(all_o, order, 1)
    if least <= 1:  # what has dropped out of a full beam but is similar enough is opened as well
        q, v = np.concatenate(hit_q), np.concatenate(hit_v)
        done = np.zeros((m, n), dtype=bool)
        r, c = np.nonzero(opened)
        done[r, ids[r, c]] = True
        front = ~done[q, v]
        fq, fv = q[front], v[front]
        while len(fq):
            nq, nv, s = meet(fq, fv)
            hit = s >= least
            fq, fv = nq[hit], nv[hit]
            hit_q.append(fq)
            hit_v.append(fv)
    return ids, sims, np.concatenate(hit_q), np.concatenate(hit_v)
