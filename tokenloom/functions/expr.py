"""Frequency and association measures as Column expressions (PRJ5-8, AGG13-15)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pmw(freq: Column, total: Column) -> Column:
    """Occurrences per million words, 4 places; 0 where the total is 0."""
    return F.when(total > 0, F.round(freq / total * 1e6, 4)).otherwise(F.lit(0.0))


def zipf(per_million: Column) -> Column:
    """log10(PMW)+3; null unless PMW > 0."""
    return F.when(per_million > 0, F.log10(per_million) + 3)


def band(z: Column) -> Column:
    """Zipf band 1 (commonest) to 5; null for null."""
    return F.when(z >= 7, 1).when(z >= 6, 2).when(z >= 5, 3).when(z >= 4, 4).when(z.isNotNull(), 5)


def ll_term(observed: Column, expected: Column) -> Column:
    """O ln(O/E), 0 unless both are positive."""
    return F.when((observed > 0) & (expected > 0), observed * F.log(observed / expected)).otherwise(F.lit(0.0))


def significance(ll: Column) -> Column:
    """Labels by log-likelihood; the strings are fixed values (Q5)."""
    return (
        F.when(ll >= 15.13, "*** (p<0.001)").when(ll >= 10.83, "** (p<0.01)").when(ll >= 3.84, " * (p<0.05)").otherwise("ns")
    )


def collocation_cells(observed: Column, node_freq: Column, total_freq: Column, n: Column) -> dict[str, Column]:
    """The 2x2 table of a collocate; the last cell is N minus the clipped sum of the others (Q3)."""
    k11 = observed.cast("double")
    k12 = node_freq - k11
    k21 = total_freq - k11
    k22 = n - F.greatest(k11 + k12 + k21, F.lit(0.0))
    return {"k11": k11, "k12": k12, "k21": k21, "k22": k22}


def collocation_ll(cells: dict[str, Column], n: Column) -> Column:
    """Four-cell log-likelihood, 6 places."""
    r1, r2 = cells["k11"] + cells["k12"], cells["k21"] + cells["k22"]
    c1, c2 = cells["k11"] + cells["k21"], cells["k12"] + cells["k22"]
    total = sum(
        (ll_term(o, r * c / n) for o, r, c in ((cells["k11"], r1, c1), (cells["k12"], r1, c2), (cells["k21"], r2, c1), (cells["k22"], r2, c2))),
        F.lit(0.0),
    )
    return F.round(F.coalesce(2 * total, F.lit(0.0)), 6)


def mutual_information(cells: dict[str, Column], n: Column) -> Column:
    """log2(O/E) of the first cell, 6 places; 0 unless both are positive."""
    expected = (cells["k11"] + cells["k12"]) * (cells["k11"] + cells["k21"]) / n
    return F.round(F.when((cells["k11"] > 0) & (expected > 0), F.log2(cells["k11"] / expected)).otherwise(0.0), 6)


def keyword_ll(o1: Column, o2: Column, n1: Column, n2: Column) -> Column:
    """Two-cell log-likelihood of a word in two corpora."""
    both = o1 + o2
    return 2 * (ll_term(o1.cast("double"), n1 * both / (n1 + n2)) + ll_term(o2.cast("double"), n2 * both / (n1 + n2)))


def log_ratio(o1: Column, o2: Column, n1: Column, n2: Column) -> Column:
    """Binary logarithm of the ratio of relative frequencies, 0.5 added throughout."""
    return F.log2(((o1 + 0.5) / (n1 + 0.5)) / ((o2 + 0.5) / (n2 + 0.5)))


def ttr(types: Column, tokens: Column) -> Column:
    return F.when(tokens > 0, F.round(types / tokens, 4)).otherwise(F.lit(0.0))


def chi2_yates(f1: Column, t1: Column, f2: Column, t2: Column) -> Column:
    """Chi-squared of [[f1, t1-f1], [f2, t2-f2]], each deviation reduced by at most 0.5."""
    n = t1 + t2
    c1, c2 = f1 + f2, n - f1 - f2
    cells = ((f1, t1, c1), (t1 - f1, t1, c2), (f2, t2, c1), (t2 - f2, t2, c2))
    out = F.lit(0.0)
    for o, r, c in cells:
        e = r * c / n
        d = F.abs(o - e)
        out = out + F.when(e > 0, F.pow(d - F.least(F.lit(0.5), d), F.lit(2.0)) / e).otherwise(F.lit(0.0))
    return out


def cohen_h(p1: Column, p2: Column) -> Column:
    return 2 * (F.asin(F.sqrt(p1)) - F.asin(F.sqrt(p2)))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def correlation_label(r: Column) -> Column:
    """STA13."""
    a = F.abs(r)
    strength = F.when(a >= 0.8, "Very Strong").when(a >= 0.6, "Strong").when(a >= 0.4, "Moderate").when(a >= 0.2, "Weak").otherwise("Negligible")
    return F.concat_ws(" ", strength, F.when(r >= 0, "Positive").otherwise("Negative"))
