"""Density clustering of a few points, written out plainly to check the Spark version."""

import numpy as np

LEAST = 1e-12


def brute_labels(x: np.ndarray, min_cluster_size: int, min_samples: int) -> np.ndarray:
    n = len(x)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, min_samples]
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    inside = np.zeros(n, dtype=bool)
    inside[0] = True
    best, source = reach[0].copy(), np.zeros(n, dtype=int)
    edges = []
    for _ in range(n - 1):
        j = int(np.argmin(np.where(inside, np.inf, best)))
        edges.append((best[j], int(source[j]), j))
        inside[j] = True
        closer = reach[j] < best
        best[closer], source[closer] = reach[j][closer], j
    edges.sort()
    # Merge bottom-up; groups of at least min_cluster_size carry a cluster.
    group = {i: [i] for i in range(n)}
    of = list(range(n))
    cluster_of_group = {}
    clusters = []  # dict(points: {p: entry distance}, children, end)
    for w, a, b in edges:
        ga, gb = of[a], of[b]
        merged = group[ga] + group[gb]
        ca, cb = cluster_of_group.get(ga), cluster_of_group.get(gb)
        if ca is not None and cb is not None:
            clusters.append({"points": {}, "children": [ca, cb], "end": np.inf})
            clusters[ca]["end"] = clusters[cb]["end"] = w
            now = len(clusters) - 1
        elif ca is not None or cb is not None:
            now = ca if ca is not None else cb
            for p in group[gb] if ca is not None else group[ga]:
                clusters[now]["points"][p] = w
        elif len(merged) >= min_cluster_size:
            clusters.append({"points": {p: w for p in merged}, "children": [], "end": np.inf})
            now = len(clusters) - 1
        else:
            now = None
        group.pop(gb)
        group[ga] = merged
        for p in merged:
            of[p] = ga
        cluster_of_group.pop(gb, None)
        if now is not None:
            cluster_of_group[ga] = now
    labels = np.full(n, -1)
    if len(clusters) < 2:
        return labels

    def everyone(c):
        found = list(clusters[c]["points"])
        for child in clusters[c]["children"]:
            found += everyone(child)
        return found

    def closeness(distance):
        return 1.0 / max(distance, LEAST)

    best_of = {}

    def solve(c):
        mine = clusters[c]
        birth = closeness(mine["end"])
        value = sum(closeness(w) - birth for w in mine["points"].values())
        below, picks = 0.0, []
        for child in mine["children"]:
            inner, chosen = solve(child)
            below += inner
            picks += chosen
            value += len(everyone(child)) * (closeness(clusters[child]["end"]) - birth)
        best_of[c] = value
        if not mine["children"] or value >= below:
            return value, [c]
        return below, picks

    root = len(clusters) - 1
    chosen = [c for child in clusters[root]["children"] for c in solve(child)[1]]
    for label, c in enumerate(chosen):
        labels[everyone(c)] = label
    return labels
