"""Worked examples: small token tables with known results."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tokenloom.functions import special
from tokenloom.model import Corpus
from tokenloom.operators import collocation, compare, distribution, features, keyword, kwic, multivariate, ngram, stats
from tokenloom.plans import positions
from tokenloom.plans.terms import parse_query


def table(spark, words, **columns):
    rows = [(i, w, w.lower(), "X", w.lower(), 1, "f", *[c[i] for c in columns.values()]) for i, w in enumerate(words)]
    schema = "id bigint, token string, _token_low string, pos string, lemma string, sent_id bigint, filename string"
    for name, values in columns.items():
        schema += f", {name} {'int' if isinstance(values[0], int) else 'string'}"
    return Corpus.of(spark.createDataFrame(rows, schema))


@pytest.fixture(scope="module")
def apples(spark):
    words = ["I", "eat", "apple"] * 10 + ["I", "eat", "banana"] * 10
    return table(spark, words, speaker=["A"] * 30 + ["B"] * 30, year=[2000] * 30 + [2005] * 30)


def rows(df, key):
    return {r[key]: r for r in df.collect()}


def test_restricted_collocates_look_at_the_node_only(apples):
    found = rows(collocation.collocations(apples, "eat", window=1, restrictions={"speaker": ["A"]}), "collocate")
    assert found["apple"]["observed"] == 10 and "banana" not in found
    assert found["apple"]["ll"] == pytest.approx(38.19085, abs=1e-5) and found["i"]["mi"] == pytest.approx(1.584963, abs=1e-6)


def test_unrestricted_collocates(apples):
    found = rows(collocation.collocations(apples, "eat", window=1), "collocate")
    assert found["apple"]["ll"] == pytest.approx(26.341458, abs=1e-6) and found["apple"]["direction"] == "R"
    assert found["i"]["ll"] == pytest.approx(76.3817, abs=1e-4) and found["i"]["direction"] == "L"


def test_restricted_bigrams(apples):
    found = rows(ngram.ngrams(apples, 2, restrictions={"speaker": ["B"]}), "ngram")
    assert "eat apple" not in found and found["eat banana"]["frequency"] == 10


def test_bigrams_bridge_what_is_left_out(spark):
    c = table(spark, ["a", ",", "b", ".", "c"])
    assert set(rows(ngram.ngrams(c, 2, skip_punctuation=True), "ngram")) == {"a b", "b c"}


def test_ngrams_of_an_empty_or_short_table(spark):
    c = table(spark, ["a"])
    assert ngram.ngrams(c, 2).count() == 0
    assert ngram.ngrams(Corpus(c.tokens.limit(0)), 2).count() == 0


def test_min_freq_per_side(spark):
    c = table(spark, ["x", "n", "x", "n", "x", "q", "x", "n", "z"])
    assert "x" in rows(collocation.collocations(c, "n", window=1, min_freq=2), "collocate")
    side = collocation.collocations(table(spark, ["x", "n", "x"]), "n", window=1, min_freq=2)
    total = collocation.collocations(table(spark, ["x", "n", "x"]), "n", window=1, min_freq=2, min_freq_on="total")
    assert side.count() == 0 and total.count() == 1


def test_keywords_against_a_list(spark):
    c = table(spark, ["apple"] * 20 + ["common"] * 5)
    ref = spark.createDataFrame([("apple", 10), ("common", 500)], "token string, freq bigint")
    found = rows(keyword.keywords(c, ref_freq=ref, ref_total=1000, min_freq=1), "token")
    assert found["apple"]["ll"] == pytest.approx(110.845885, abs=1e-6) and found["apple"]["type"] == "Positive"
    assert found["common"]["log_ratio"] == pytest.approx(-1.213715, abs=1e-6) and found["common"]["type"] == "Negative"


def test_absent_words_may_come_out_positive(spark):
    c = table(spark, ["x"] * 25)
    ref = spark.createDataFrame([("rare", 10)], "token string, freq bigint")
    found = rows(keyword.keywords(c, ref_freq=ref, ref_total=1000), "token")["rare"]
    assert found["freq_t"] == 0 and found["ll"] == pytest.approx(0.493852, abs=1e-6) and found["type"] == "Positive"


def test_grouped_keywords(spark):
    c = table(spark, ["apple"] * 20 + ["common"] * 5 + ["python"] * 20 + ["common"] * 5, domain=["fruit"] * 25 + ["tech"] * 25)
    ref = spark.createDataFrame([("apple", 10), ("banana", 10), ("common", 500)], "token string, freq bigint")
    found = keyword.grouped_keywords(c, "domain", ref, ref_total=1000, min_freq=1)
    top = keyword.top_keywords(found, 1, "domain").where("type = 'Positive'").collect()
    assert {r["domain"]: r["token"] for r in top} == {"fruit": "apple", "tech": "python"}
    with pytest.raises(ValueError):
        keyword.grouped_keywords(c, "domain", ref, max_groups=1)


def test_wildcards(spark):
    c = table(spark, "berikan bantuan kepada masyarakat berikan dukungan kepada warga".split())
    ids = lambda q, **o: sorted(r["id"] for r in positions.matches(c, parse_query(q, **o)).collect())
    assert ids("ber*") == [0, 4] and ids("*kan") == [0, 4] and ids("b*n") == [0, 1, 4] and ids("ber* bantuan") == [0]
    assert ids("[bant]*", keep_affixes=True) == [1]


def test_tag_spans_take_part_in_sequences(spark):
    words = "at New Era Pizzeria is".split()
    data = [(i + 1, w, w.lower(), "##TAG", w, 1, "f", 0 < i < 4, i == 1, 3 if i == 1 else None) for i, w in enumerate(words)]
    schema = "id bigint, token string, _token_low string, pos string, lemma string, sent_id bigint, filename string, in_pn boolean, in_pn_start boolean, pn_len int"
    c = Corpus.of(spark.createDataFrame(data, schema))
    found = positions.with_text(positions.matches(c, parse_query("at <PN> is")), c.tokens).collect()
    assert [(r["id"], r["len"], r["match_token"]) for r in found] == [(1, 5, "at New Era Pizzeria is")]
    assert positions.matches(c, parse_query("_NN")).count() == 5  # an untagged corpus: POS says nothing


def test_kwic_edges_sample_and_sort(apples):
    first = kwic.kwic(apples, "eat", left=3, right=1, limit=1).collect()[0]
    assert (first["left"], first["node"], first["right"]) == ("I", "eat", "apple")
    assert kwic.kwic(apples, "eat", limit=5, sample=True).count() == 5 and kwic.kwic(apples, "nothing").count() == 0
    near = kwic.kwic(apples, "i", collocate="banana", window=2, limit=None)
    assert near.count() == 10 and {r["collocate"] for r in near.collect()} == {"banana"}
    ordered = kwic.sort_lines(kwic.kwic(apples, "eat", limit=None), "right", descending=True).collect()
    assert ordered[0]["right"].startswith("banana")


def test_halo_windows_equal_one_global_window(spark, monkeypatch):
    from pyspark.sql import Window

    monkeypatch.setattr(positions, "CHUNK", 7)
    data = spark.createDataFrame([(i * 3, f"w{i % 5}") for i in range(100)], "id bigint, t string")
    got = sorted((r["t_1"], r["t_2"] or "", r["t_3"] or "") for r in positions.leads(data, ["t"], 3).collect())
    w = Window.partitionBy().orderBy("id")
    want = data.select(F.col("t").alias("a"), F.lead("t", 1).over(w).alias("b"), F.lead("t", 2).over(w).alias("c")).collect()
    assert got == sorted((r["a"], r["b"] or "", r["c"] or "") for r in want)


def test_contexts_equal_a_range_join(spark, apples):
    hits = positions.matches(apples, parse_query("apple"))
    got = sorted((r["id"], r["pos_id"]) for r in positions.around(hits, apples.tokens, 2, 3, ["token"]).collect())
    ids = [r["id"] for r in hits.collect()]
    assert got == sorted((i, p) for i in ids for p in range(i - 2, i + 4) if 0 <= p < 60)


def test_segments_add_up(apples):
    for densify in (False, True):
        found = distribution.segments(apples, "eat", densify=densify).collect()
        assert len(found) == 100 and sum(r["absolute"] for r in found) == 20


def test_group_comparison_values():
    assert math.erfc(math.sqrt(25.11847 / 2)) == pytest.approx(5.3914e-07, rel=1e-4)
    assert special.correlation_p(0.9, 5) == pytest.approx(0.0373861, abs=1e-6)
    assert special.correlation_p(1.0, 4) == 0 and math.isnan(special.correlation_p(0.5, 2))


def test_chi_squared(spark):
    words = ["w"] * 45 + ["o"] * 955 + ["w"] * 8 + ["o"] * 992
    c = table(spark, words, g=["a"] * 1000 + ["b"] * 1000)
    r = stats.compare_groups(c, "w", "g", ("a", "b"), correction="none").collect()[0]
    assert r["chi2"] == pytest.approx(25.11847, abs=1e-5) and r["effect_size"] == pytest.approx(0.248387, abs=1e-6)
    assert r["p_value"] == pytest.approx(5.3914e-07, rel=1e-4) and r["significance"] == "***"
    with pytest.raises(ValueError):
        stats.compare_groups(c, "w o", "g", ("a", "b"))


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.2, 0.03]
    df = stats.adjusted(spark.createDataFrame([(x,) for x in p], "p_value double"), "bh")
    got = sorted(r["p_corrected"] for r in df.collect())
    order, want, low = sorted(p), [], 1.0
    for i in range(len(order), 0, -1):
        low = min(low, order[i - 1] * len(order) / i)
        want.append(low)
    assert got == pytest.approx(sorted(want))


def test_correlation_drops_or_fills(spark):
    x = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", 9.0)], "group string, value double")
    y = spark.createDataFrame([("a", 2.0), ("b", 4.0), ("c", 6.0)], "group string, value double")
    assert stats.correlation(x, y).collect()[0]["r"] == pytest.approx(1.0)
    assert stats.correlation(x, y, zero_fill=True).collect()[0]["n"] == 4
    assert stats.correlation(x.limit(1), y).collect()[0]["r"] is None


def test_feature_matrix_and_clusters(spark):
    c = Corpus.of(
        spark.createDataFrame(
            [(i, t, t, "NN", t, 1, f) for i, (f, t) in enumerate([("A", "apple"), ("A", "apple"), ("A", "orange"), ("A", "banana"), ("B", "orange"), ("B", "banana"), ("B", "strawberry"), ("C", "computer"), ("C", "computer"), ("C", "mouse")], 1)],
            "id bigint, token string, _token_low string, pos string, lemma string, sent_id bigint, filename string",
        )
    )
    m = features.feature_matrix(c)
    cells = {(r["group"], r["feature"]): r["freq"] for r in m.collect()}
    assert cells["A", "apple"] == 2 and cells["C", "apple"] == 0
    merged = multivariate.cluster(m).orderBy("step").collect()
    assert len(merged) == 2 and merged[0]["members"] == ["A", "B"]
    assert "A and B" in multivariate.cluster_text(multivariate.cluster(m))
    ca = multivariate.correspondence(m)
    assert ca.where("kind = 'row'").count() == 6 and "dimension" in multivariate.correspondence_text(ca)
    assert multivariate.principal_components(m, 2).count() == 6


def test_linkage_of_points_on_a_line():
    import numpy as np

    x = np.array([[0.0], [1.0], [5.0], [7.0]])
    for method, height in (("single", 4.0), ("complete", 7.0), ("average", 5.5)):
        z = multivariate.linkage(multivariate.pairwise(x), 4, method)
        assert z[0, 2] == 1 and z[1, 2] == 2 and z[2, 2] == pytest.approx(height)


def test_comparison(spark):
    a = spark.createDataFrame([("x", 3), ("Y", 1)], "ngram string, frequency bigint")
    b = spark.createDataFrame([("x", 1), ("y", 5), ("z", 2)], "ngram string, frequency bigint")
    shared, only_a, only_b = compare.compare(a, b, "ngram", {"frequency": "freq"})
    assert [tuple(r) for r in shared.collect()] == [("x", 3, 1, 2)] and only_a.count() == 0 and [r["ngram"] for r in only_b.collect()] == ["z"]
    assert compare.summary(shared, only_a, only_b).collect()[0]["overlap"] == 50.0


def test_repeated_null_and_clashing_rows(spark):
    data = [(1, "A", None, "NN", "a", 1, "f", "x"), (1, "A", None, "NN", "a", 1, "f", "x"), (2, None, None, None, None, None, None, None), (None, "B", "b", "NN", "b", 1, "f", "x"), (3, "a", "a", "NN", "a", 0, "f", "")]
    schema = "id bigint, token string, _token_low string, pos string, lemma string, sent_id bigint, filename string, block string"
    c = Corpus.of(spark.createDataFrame(data, schema))
    assert c.size == 3 and {r["_token_low"]: r["freq"] for r in c.frequencies.collect()} == {"a": 2, None: 1}
    assert kwic.kwic(c, "a").count() == 2
    assert ngram.ngrams(c, 2).count() == 0
    assert collocation.collocations(c, "a").count() == 1
    empty = Corpus(c.tokens.limit(0))
    assert kwic.kwic(empty, "a").count() == 0 and collocation.collocations(empty, "a").count() == 0
    assert distribution.by_attributes(c, "a", ["block"]).collect()[0]["absolute"] == 1


def test_neighbours_far_apart(spark, monkeypatch):
    """Rows left out thickly: chunks whose halo is too short are numbered densely, words
    whose neighbours are far are looked for further away."""
    from tokenloom.operators import dictionary
    from tokenloom.plans import positions

    monkeypatch.setattr(positions, "CHUNK", 8)
    monkeypatch.setattr(positions, "HALO", 3)
    words = ["x" if i % 7 == 0 else "," for i in range(200)]
    for k, w in ((63, "lamp"), (70, "a"), (77, "b"), (56, "c"), (49, "d"), (196, "lamp")):
        words[k] = w
    c = table(spark, words)
    kept = [w for w in words if w != ","]
    got = {r["ngram"]: r["frequency"] for r in ngram.ngrams(c, 3, skip_punctuation=True).collect()}
    assert got == dict(Counter(" ".join(kept[i : i + 3]) for i in range(len(kept) - 2)))
    near = {r["id"]: r["_at"] for r in dictionary.nearest(c.tokens.where("_token_low <> ','"), "lamp", 3, reach=2).collect()}
    first, last = sorted(near)
    assert near[first] == {0: "lamp", 1: "a", 2: "b", 3: "x", -1: "c", -2: "d", -3: "x"} and set(near[last]) == {0, -1, -2, -3}
    assert dictionary.nearest(c.tokens, "nowhere", 3).count() == 0


def test_many_hits_and_few_give_the_same(spark, monkeypatch):
    from tokenloom.operators import kwic as concordance
    from tokenloom.plans import positions

    c = table(spark, ["a", "b", "c", "a", "d"] * 20)
    few = sorted(map(tuple, concordance.kwic(c, "a", left=2, right=2, limit=None, metadata=False).collect()))
    monkeypatch.setattr(positions, "FEW", 3)
    assert sorted(map(tuple, concordance.kwic(c, "a", left=2, right=2, limit=None, metadata=False).collect())) == few


def test_running_sums_and_corrections(spark):
    from tokenloom.operators import stats
    from tokenloom.plans.dense import running

    df = spark.createDataFrame([(float(i), i % 5) for i in range(100)], "k double, v int")
    got = {r["k"]: r["s"] for r in running(df, "k", "v", "s").collect()}
    assert got == {float(i): float(sum(j % 5 for j in range(i + 1))) for i in range(100)}
    low = {r["k"]: r["s"] for r in running(df.withColumn("v", F.abs(F.col("k") - 50)), "k", "v", "s", how="min", descending=True).collect()}
    assert low[99.0] == 49.0 and low[50.0] == 0.0 and low[0.0] == 0.0
    p = [0.01, 0.02, 0.02, 0.5, 0.9]
    tested = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p_value double")
    adjusted = {r["i"]: r["p_corrected"] for r in stats.adjusted(tested, "bh").collect()}
    want, least = {}, 1.0
    for i in reversed(range(5)):
        least = min(least, p[i] * 5 / (i + 1))
        want[i] = least
    want[1] = want[2]
    assert all(abs(adjusted[i] - want[i]) < 1e-12 for i in range(5))
    assert running(df.limit(0), "k", "v", "s").count() == 0


def test_tail_probabilities():
    import math

    import numpy as np

    from tokenloom.functions.special import erfc

    z = np.array([0.0, 1e-9, 0.3, 1.0, 1.999, 2.0, 3.0, 5.0, 10.0, 26.0, np.nan])
    got = erfc(z)
    assert np.isnan(got[-1]) and all(abs(g - math.erfc(x)) <= 1e-12 * math.erfc(x) for g, x in zip(got[:-1], z[:-1]))


def test_unnumbered_rows_and_groups(spark):
    from tokenloom.operators import features, overview

    c = table(spark, ["a", "b", "c", "d"])
    texts = overview.sentence_texts(c)
    assert texts.count() >= 1 and sum(len(r["text"].split()) for r in texts.collect()) == 4
    with pytest.raises(ValueError):
        overview.by_attribute(c, "_token_low", max_values=3)
    m = spark.createDataFrame([(g, f, v) for g, f, v in (("x", "a", 1), ("x", "b", 0), ("y", "a", 3), ("y", "b", 4))], "group string, feature string, freq int")
    assert [r["distance"] for r in features.distances(m).collect()] == [6.0] and features.distances(m, metric="euclidean").first()["distance"] == pytest.approx(20**0.5)
    with pytest.raises(ValueError):
        features.distances(m, max_groups=1)


def test_shared_folder_is_required_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from tokenloom import session

    conf = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077", applicationId="x"))
    with pytest.raises(RuntimeError):
        session.shared_dir(cluster)


def test_changed_tables_are_loaded_again(spark, tmp_path):
    from tokenloom.model import Corpus

    path = f"{tmp_path}/corpus.parquet"
    table(spark, ["a", "b"]).tokens.write.parquet(path)
    first = Corpus.load(spark, path)
    assert Corpus.load(spark, path) is first and first.size == 2
    table(spark, ["a", "b", "c"]).tokens.write.mode("overwrite").parquet(path)
    assert Corpus.load(spark, path).size == 3
