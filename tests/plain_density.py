"""Density clustering on one machine, written out plainly: what the operators are held against."""

import numpy as np

FLOOR = 1e-12


def distances(v):
    return np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))


def core(d, min_samples):
    return np.sort(d, axis=1)[:, min_samples - 1]


def tree(v, min_samples):
    """Edges (weight, low, high) of the minimum spanning tree of mutual reachability, in the order of their merging."""
    d = distances(v)
    c = core(d, min_samples)
    w = np.maximum(np.maximum(c[:, None], c[None]), d)
    every = sorted((w[i, j], i, j) for i in range(len(v)) for j in range(i + 1, len(v)))
    root = list(range(len(v)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    out = []
    for weight, i, j in every:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((weight, i, j))
    return out


def clustered(v, min_size, min_samples):
    """Labels by stability, -1 for noise; labels in no order."""
    n, edges = len(v), tree(v, min_samples)
    members, node_of, children, weight = {i: [i] for i in range(n)}, list(range(n)), {}, {}
    for k, (w, i, j) in enumerate(edges):
        a, b = node_of[i], node_of[j]
        new = n + k
        children[new], weight[new], members[new] = (a, b), w, members[a] + members[b]
        for x in members[new]:
            node_of[x] = new
    top = n + len(edges) - 1
    stability, below, fallen, birth = {}, {}, {}, {}

    def rate(w):
        return 1 / max(w, FLOOR)

    todo = [(top, 0.0)]
    while todo:
        head, born = todo.pop()
        stability[head], below[head], fallen[head], birth[head] = 0.0, [], {}, born
        at = head
        while True:
            if at < n:
                break
            r = rate(weight[at])
            big = [x for x in children[at] if len(members[x]) >= min_size]
            for x in children[at]:
                if x not in big:
                    stability[head] += (r - born) * len(members[x])
                    fallen[head].update(dict.fromkeys(members[x], r))
            if len(big) == 1:
                at = big[0]
                continue
            for x in big:
                stability[head] += (r - born) * len(members[x])
                below[head].append(x)
                todo.append((x, r))
            break
    chosen, best = {}, {}
    for head in sorted(stability):
        rest = sum(best[x] for x in below[head])
        chosen[head] = not below[head] or stability[head] >= rest
        best[head] = max(stability[head], rest) if below[head] else stability[head]
    labels = np.full(n, -1)
    todo = [top]
    while todo:
        head = todo.pop()
        if chosen[head]:
            labels[members[head]] = head
            if head == top:  # a single cluster of all: what stays to the last
                rates = [*fallen[head].values(), *(birth[x] for x in below[head])]
                last = max(rates)
                labels[[x for x in range(n) if fallen[head].get(x, last if below[head] else -1.0) < last]] = -1
            continue
        todo += below[head]
    return labels
