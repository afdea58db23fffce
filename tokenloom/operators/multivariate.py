"""Clustering, correspondence analysis and principal components (STA5-STA8, STA10).

The matrices are small by their definition (chosen groups by top features); they are
brought to the driver after a check of their size and handled with numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

#: Cells of a matrix that may come to the driver.
MAX_CELLS = 5_000_000


def to_matrix(matrix: DataFrame, value: str = "freq") -> tuple[list[str], list[str], np.ndarray]:
    """Groups, features and the dense matrix of a long-form matrix, both in order."""
    cells = matrix.count()
    if cells > MAX_CELLS:
        raise ValueError(f"{cells} cells; choose fewer groups or features")
    t = matrix.select("group", "feature", value).toPandas()
    groups, features = sorted(t["group"].unique()), sorted(t["feature"].unique())
    at_g, at_f = {g: i for i, g in enumerate(groups)}, {f: i for i, f in enumerate(features)}
    out = np.zeros((len(groups), len(features)))
    out[t["group"].map(at_g), t["feature"].map(at_f)] = t[value].astype(float)
    return groups, features, out


def row_percent(x: np.ndarray) -> np.ndarray:
    total = x.sum(axis=1, keepdims=True)
    return np.divide(x, total, out=np.zeros_like(x), where=total != 0) * 100


def standardise(x: np.ndarray) -> np.ndarray:
    """Column z-scores (ddof 1, a deviation of 0 counts as 1)."""
    sd = x.std(axis=0, ddof=1) if len(x) > 1 else np.ones(x.shape[1])
    return (x - x.mean(axis=0)) / np.where((sd == 0) | np.isnan(sd), 1, sd)


def pairwise(x: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Condensed distances: euclidean, cityblock, cosine or correlation."""
    i, j = np.triu_indices(len(x), 1)
    if metric == "cityblock":
        return np.abs(x[i] - x[j]).sum(axis=1)
    if metric in ("cosine", "correlation"):
        y = x - x.mean(axis=1, keepdims=True) if metric == "correlation" else x
        norm = np.linalg.norm(y, axis=1)
        product = norm[i] * norm[j]
        return 1 - np.divide((y[i] * y[j]).sum(axis=1), product, out=np.zeros(len(i)), where=product > 0)
    return np.sqrt(((x[i] - x[j]) ** 2).sum(axis=1))


def linkage(condensed: np.ndarray, n: int, method: str = "ward") -> np.ndarray:
    """Agglomerative clustering by the Lance-Williams formula: rows of first and second
    cluster, height, size; clusters from n on are merged ones."""
    d = np.full((n, n), np.inf)
    i, j = np.triu_indices(n, 1)
    d[i, j] = d[j, i] = condensed
    label, size, alive = list(range(n)), np.ones(n), np.ones(n, dtype=bool)
    out = np.zeros((max(0, n - 1), 4))
    for step in range(n - 1):
        masked = np.where(alive[:, None] & alive[None, :], d, np.inf)
        a, b = divmod(int(np.argmin(masked)), n)
        a, b = min(a, b), max(a, b)
        height, na, nb = d[a, b], size[a], size[b]
        out[step] = (min(label[a], label[b]), max(label[a], label[b]), height, na + nb)
        da, db = d[a], d[b]
        if method == "single":
            new = np.minimum(da, db)
        elif method == "complete":
            new = np.maximum(da, db)
        elif method == "average":
            new = (na * da + nb * db) / (na + nb)
        elif method == "ward":
            nk = size
            with np.errstate(invalid="ignore"):
                new = np.sqrt(np.maximum(((na + nk) * da**2 + (nb + nk) * db**2 - nk * height**2) / (na + nb + nk), 0))
        else:
            raise ValueError(f"unknown method: {method}")
        new[~alive] = np.inf
        new[[a, b]] = np.inf
        d[a], d[:, a] = new, new
        d[a, a] = np.inf
        alive[b], size[a], label[a] = False, na + nb, n + step
    return out


def cluster(matrix: DataFrame, *, metric: str = "euclidean", method: str = "ward", use_z: bool = True, already_standardised: bool = False) -> DataFrame:
    """STA5: step, left, right, height, size, and the merged groups (members).

    Rows are made percentages, then z-scores; already_standardised leaves both out (Q35)."""
    groups, _, x = to_matrix(matrix, "z" if already_standardised else "freq")
    if not already_standardised:
        x = row_percent(x)
        x = standardise(x) if use_z else x
    merged = linkage(pairwise(x, metric), len(groups), method)
    members: list[list[str]] = [[g] for g in groups]
    rows = []
    for k, (a, b, height, size) in enumerate(merged):
        members.append(sorted(members[int(a)] + members[int(b)]))
        rows.append((k + 1, int(a), int(b), float(height), int(size), members[-1]))
    return matrix.sparkSession.createDataFrame(rows, "step int, left int, right int, height double, size int, members array<string>")


def cluster_text(clusters: DataFrame) -> str:
    """STA6: a plain description of the first and the last merge."""
    rows = clusters.orderBy("step").collect()
    if not rows:
        return "There are fewer than two groups."
    first, last = rows[0], rows[-1]
    return (
        f"{len(rows) + 1} groups were clustered. The closest are {' and '.join(first['members'])} (height {first['height']:.3f}). "
        f"All groups join at height {last['height']:.3f}."
    )


def correspondence(matrix: DataFrame, dimensions: int = 2) -> DataFrame:
    """STA7: kind ('row' or 'column'), name, dimension, coordinate, inertia (share of the
    dimension). Zero rows and columns are dropped; signs are set so that the largest row
    coordinate of a dimension is positive."""
    groups, features, x = to_matrix(matrix)
    keep_r, keep_c = x.sum(1) > 0, x.sum(0) > 0
    x = x[keep_r][:, keep_c]
    rows: list[tuple] = []
    if x.size:
        p = x / x.sum()
        r, c = p.sum(1), p.sum(0)
        u, s, v = np.linalg.svd((p - np.outer(r, c)) / np.sqrt(np.outer(r, c)), full_matrices=False)
        share = s**2 / max(float((s**2).sum()), 1e-300)
        f, g = u * s / np.sqrt(r)[:, None], v.T * s / np.sqrt(c)[:, None]
        for k in range(min(dimensions, len(s))):
            sign = 1.0 if f[np.argmax(np.abs(f[:, k])), k] >= 0 else -1.0
            for kind, names, at in (("row", [n for n, t in zip(groups, keep_r) if t], f), ("column", [n for n, t in zip(features, keep_c) if t], g)):
                rows += [(kind, str(n), k + 1, float(sign * at[i, k]), float(share[k])) for i, n in enumerate(names)]
    return matrix.sparkSession.createDataFrame(rows, "kind string, name string, dimension int, coordinate double, inertia double")


def correspondence_text(coordinates: DataFrame) -> str:
    """STA8: which rows and columns lie at the ends of the first dimension."""
    rows = [r for r in coordinates.where("dimension = 1").collect()]
    if not rows:
        return "There is nothing to describe."
    ends = {}
    for kind in ("row", "column"):
        own = sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["coordinate"])
        ends[kind] = (own[0]["name"], own[-1]["name"])
    return (
        f"The first dimension holds {rows[0]['inertia'] * 100:.1f} % of the inertia. It sets {ends['row'][0]} (with {ends['column'][0]}) "
        f"against {ends['row'][1]} (with {ends['column'][1]})."
    )


def principal_components(matrix: DataFrame, components: int = 10, value: str = "freq") -> DataFrame:
    """STA10: group, component, score, variance (share). Signs as in correspondence()."""
    groups, _, x = to_matrix(matrix, value)
    rows: list[tuple] = []
    if len(groups) > 1:
        u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
        share = s**2 / max(float((s**2).sum()), 1e-300)
        for k in range(min(components, len(s))):
            score = u[:, k] * s[k]
            score = score if score[np.argmax(np.abs(score))] >= 0 else -score
            rows += [(g, k + 1, float(v), float(share[k])) for g, v in zip(groups, score)]
    return matrix.sparkSession.createDataFrame(rows, "group string, component int, score double, variance double")
