"""Each problem against brute force, round trips or held-out accuracy."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import contamination, cooccurrence, encoding, fm_index, frequency, packing, sentences, splitting, subjects
from tokenloom.llm.queries import VOCABULARY
from tokenloom.llm.tokens import encoding as tokenizer

TOKENS = "id bigint, doc_id bigint, filename string, sent_id bigint, token string, _token_low string, lemma string, lang string, topic string, block string"


def corpus(spark, rows):
    """rows of (id, doc_id, filename, sent_id, token, lang); everything else follows."""
    return spark.createDataFrame([(i, d, f, s, t, t and t.lower(), t and t.lower(), g, None, "clash") for i, d, f, s, t, g in rows], TOKENS)


# 1 -------------------------------------------------------------------------------------


@pytest.mark.parametrize("chain", [c for c in encoding.CHAINS if c[0] not in encoding.ONLY])
def test_chains_round_trip(chain):
    for word in ("über", "déjà", "naïve", "“so”", "नदी", "ครับ", "Straße"):
        bad = encoding.garble(word, chain)
        if bad and "�" not in bad and "?" not in bad:
            assert encoding.invert(bad, chain) == word


def test_damaged_tokens_come_out_and_back(spark):
    rng = random.Random(3)
    words = {"de": ["über", "für", "Straße", "Hügel", "Brücke", "schön", "größer"], "fr": ["été", "prière", "château", "où", "déjà"], "ja": ["家", "神社", "私たち", "報告", "書いた"], "ar": ["البيت", "النهر", "كتب", "الصباح"], "hi": ["नदी", "घर", "है"]}
    chains = {"de": 5, "fr": 3, "ja": None, "ar": None, "hi": 0}
    rows, want, n = [], {}, 0
    for _ in range(400):
        lang = rng.choice(list(words))
        word = rng.choice(words[lang])
        n += 1
        token = word
        if rng.random() < 0.2:
            steps = [c for c in encoding.CHAINS if (c[0] in encoding.ONLY) == (chains[lang] is None) and (c[0] not in encoding.ONLY or lang in encoding.ONLY[c[0]])]
            chain = rng.choice([c for c in steps if c[0][1] in ("cp1252", "mac_roman", "cp932")] or steps)
            bad = encoding.garble(word, chain)
            if bad and "�" not in bad:
                token, want[n] = bad, word
        rows.append((n, n, "f", 1, token, lang))
    for clean in ("Â", "Ã", "€", "î", "ÂGE", "10°", "’t", "Łódź-like", "｡", None, "", "plain"):
        n += 1
        rows.append((n, n, "f", 1, clean, "en" if clean != "｡" else "ja"))
    lost = n + 1
    rows += [(lost, lost, "f", 1, "�ber", "de"), (lost, lost, "f", 1, "�ber", "de"), (None, 1, "f", 1, "Ã¼ber", "de")]
    found = {r["id"]: r for r in encoding.damaged_tokens(corpus(spark, rows)).collect()}
    assert set(found) == set(want) | {lost}
    right = sum(found[i]["original"] == w for i, w in want.items())
    assert right >= 0.95 * len(want)
    assert (found[lost]["original"], found[lost]["how"]) == ("über", "vocabulary")


def test_no_rows_nothing_damaged(spark):
    assert encoding.damaged_tokens(corpus(spark, [])).count() == 0


def test_documents_are_repaired(spark):
    c = corpus(spark, [(i, i, "f", 1, w, "de") for i, w in enumerate(["über", "für", "Hügel", "Straße", "schön"])])
    docs = spark.createDataFrame([(1, "Deutsch Ã¼ber, dem HÃ¼gel", "DE"), (2, "nur ASCII", "de"), (3, None, None), (4, "Über alles", "de")], "doc_id bigint, text string, lang string")
    assert [(r["doc_id"], r["n_damaged"], r["text"]) for r in encoding.repaired_documents(docs, c).collect()] == [(1, 2, "Deutsch über, dem Hügel")]


def test_damaged_stretches_of_unspaced_texts_are_repaired(spark):
    clean = {
        "ja": ["窓", "を", "見た", "の", "話", "は", "これで", "終わり", "。", "家", "驚いた", "！", "犬", "市場", "関係", "が", "ある", "この", "…"],
        "zh": ["河边", "的", "故事", "就", "这样", "结束", "。", "大约", "名", "学生", "回答", "了", "问题", "，", "后来", "……"],
    }
    rows = [(i, i, "f", 1, w, g) for i, (g, w) in enumerate((g, w) for g in clean for w in clean[g])]
    twice, once, mac, gb, euc = (encoding.CHAINS[-1], *(((a, b),) for a, b in (("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("gb18030", "cp1252"), ("euc_jp", "cp932"))))
    bad = encoding.garble
    texts = [
        ("ja", "「" + bad("窓", once) + "を見た」の" + bad("話", twice) + "はこれで終わり｡", "「窓を見た」の話はこれで終わり｡", 2),
        ("ja", "この家は市場" + bad("の", euc) + "関係" + bad("が", mac) + "ある。", "この家は市場の関係がある。", 2),
        ("zh", "后来" + bad("河边", twice) + bad("大约", gb) + "45名学生……回答了" + bad("问题", mac) + "。", "后来河边大约45名学生……回答了问题。", 3),
        ("zh", "后来……Märkte的问题。", None, 0),
        ("ja", "窓を見た！市場の話はこれで終わり｡", None, 0),
    ]
    docs = spark.createDataFrame([(i, t[1], t[0]) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: (r["text"], r["n_damaged"], r["n_restored"]) for r in encoding.repaired_documents(docs, corpus(spark, rows)).collect()}
    assert got == {i: (want, n, n) for i, (_, _, want, n) in enumerate(texts) if want}


def test_lost_characters_of_documents_come_from_the_corpus(spark):
    words = ["über", "für", "Hügel", "Straße", "schön", "Bär", "Bör"]
    c = corpus(spark, [(i, i, "f", 1, w, "de") for i, w in enumerate(words)])
    docs = spark.createDataFrame([(1, "„H�gel“ \n�ber B�r, fÃ¼r �ber.", "GER"), (1, "�ber", "de"), (2, "�ber", "fr"), (3, "a � b", "de")], "doc_id bigint, text string, lang string")
    got = sorted((r["doc_id"], r["n_damaged"], r["n_restored"], r["text"]) for r in encoding.repaired_documents(docs, c).collect())
    assert got == [(1, 1, 1, "über"), (1, 5, 4, "„Hügel“ \nüber B�r, für über."), (2, 1, 0, "�ber"), (3, 1, 0, "a � b")]


def test_restored_tokens_are_restored_in_their_documents(spark):
    """No damaged token of the corpus that was restored is left in its repaired text: 0.9
    or more in every language."""
    d = "/root/testdata/sf0.1"
    c, docs = spark.read.parquet(f"{d}/corpus.parquet"), spark.read.parquet(f"{d}/documents.parquet")
    tokens = encoding.damaged_tokens(c).where("original IS NOT NULL").join(c.select("id", "doc_id", "lang").distinct(), "id").select("doc_id", "lang", "token").distinct().collect()
    text = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    after = text | {r["doc_id"]: r["text"] for r in encoding.repaired_documents(docs, c).collect()}
    seen, left = Counter(), Counter()
    for doc, lang, token in tokens:
        if token in text.get(doc, ""):
            seen[lang] += 1
            left[lang] += token in after[doc]
    assert len(seen) >= 9 and all(left[g] <= 0.1 * seen[g] for g in seen), (seen, left)


def test_the_model_is_fitted_in_many_tasks(spark):
    words = spark.createDataFrame([("de", f"wört{i}") for i in range(400)], "lang string, word string").coalesce(1)
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert words.distinct().repartition(spread, "word").rdd.glom().map(len).filter(lambda n: n > 0).count() > 1
    weights = encoding.fit(words)
    assert {encoding.CLEAN, encoding.GONE, "utf-8>cp1252"} <= set(weights)
    assert encoding.Classifier(weights)("wÃ¶rt5", "de")[1] == "wört5" and encoding.Classifier(weights)("w�rt5", "de") == (encoding.GONE, None)


# 2 -------------------------------------------------------------------------------------


def made_up_text(rng, thai=False):
    out = []
    for _ in range(rng.randint(3, 9)):
        body = [rng.choice(["house", "river", "lamp", "dog", "sees", "the", "a", "Mr.", "3.5"]) for _ in range(rng.randint(3, 7))]
        kind = rng.random()
        if thai:
            out.append(body[:4] + [rng.choice(["ค่ะ", "ครับ"])])
        elif kind < 0.15:
            out.append(["He", "said", ",", "“", "Is", "it", "?", "No", ".", "”"])
        elif kind < 0.25:
            out.append(["The"] + body + ["etc."])
        else:
            out.append(["The"] + body + [rng.choice([".", "?", "!"])])
    return out


def test_held_out_boundaries(spark, monkeypatch):
    monkeypatch.setattr(sentences, "BLOCK", 300)
    monkeypatch.setattr(sentences, "HALO", 60)
    rng = random.Random(5)
    rows, ends, n = [], set(), 0
    for d in range(400):
        lang = "th" if d % 4 == 0 else "en"
        hidden = d % 5 == 0
        for s, words in enumerate(made_up_text(rng, lang == "th"), 1):
            for w in words:
                n += 1
                rows.append((n, d, f"f{d}", (None if n % 2 else 0) if hidden else s, w, lang))
            if hidden:
                ends.add(n)
    rows += rows[:50]
    got = {r["id"] for r in sentences.sentence_ends(corpus(spark, rows)).collect()}
    hit = len(got & ends)
    assert hit >= 0.97 * len(ends) and hit >= 0.97 * len(got)


def test_learned_sample_is_bounded_and_whole(spark, monkeypatch):
    """What is learned stays the same size however many documents there are, and every
    n-gram of it is kept with the totals of all."""
    monkeypatch.setattr(sentences, "BLOCK", 64)
    monkeypatch.setattr(sentences, "HALO", 16)
    rng = random.Random(2)
    texts = [made_up_text(rng) for _ in range(60)]

    def learned(copies, labelled):
        rows, n = [], 0
        for d in range(60 * copies):
            for s, words in enumerate(texts[d % 60], 1):
                for w in words:
                    n += 1
                    rows.append((n, d, f"f{d}", s, w, "en"))
        model = sentences.fit(sentences.lay(corpus(spark, rows), labelled), labelled)
        gram, n1, _, total, _ = model.orders[0]
        assert total.sum() == n1.sum() and len(gram)
        return n1.sum(), n

    (few, n), (many, m) = learned(1, 10_000), learned(6, 2_000)
    assert few > n and 1_000 < many < 4_500 and m > 10_000


def test_model_is_learned_from_all_tokens(spark):
    """Every word of the documents with sentence numbers is counted, also beyond the
    200,000 tokens of a language that were once drawn, and those that make words symbols."""
    n = 260_000
    token = "CASE WHEN id % 13 = 12 THEN '.' WHEN id % 3001 = 5 THEN 'needle' ELSE concat('word', id % 7) END"
    rows = spark.range(n).selectExpr("id", "id div 26 AS doc_id", "concat('f', id div 26) AS filename", "id % 26 div 13 + 1 AS sent_id", f"{token} AS token", "'en' AS lang")
    laid = sentences.lay(rows)
    gram, counted, *_ = sentences.fit(laid).orders[0]
    of = dict(zip(gram.tolist(), counted.tolist()))
    plain = Counter("." if i % 13 == 12 else "needle" if i % 3001 == 5 else f"word{i % 7}" for i in range(n))
    for word, times in plain.items():
        key = sentences._mix(np.array([sentences._lang_key("en")], np.uint64), np.array([sentences._code(word)]))
        assert of.get(int(key[0])) == times, word
    assert sum(r.n for r in sentences.counts(laid).where("closes and gram_order = 1").collect()) >= plain["."]


def test_parts_know_all_that_they_ask_for(spark, monkeypatch):
    """What a part of the texts is given by the join is the whole model, as far as it matters."""
    monkeypatch.setattr(sentences, "BLOCK", 64)
    monkeypatch.setattr(sentences, "HALO", 16)
    monkeypatch.setattr(sentences, "PART", 2)
    rng = random.Random(8)
    rows, n = [], 0
    for d in range(90):
        lang = (None, "th", "en", "en", "id")[d % 5]
        for s, words in enumerate(made_up_text(rng, lang == "th"), 1):
            for w in words:
                n += 1
                rows.append((n, d, f"f{d}", 0 if d % 3 == 0 else s, w, lang))
    c = corpus(spark, rows)
    laid = sentences.lay(c)
    model = sentences.fit(laid)
    want = {}
    for r in laid.where("useless").collect():
        p = sentences.boundaries(model, r["lang"], [np.array(r["codes"])], [r["first"]], [r["last"]])
        want |= {i: x for i, x, own in zip(r["ids"], p, r["owned"]) if own and x >= 0.5}
    got = {r["id"]: r["posterior"] for r in sentences.sentence_ends(c).collect()}
    assert len(want) > 60 and set(got) == set(want)
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_quotations_of_any_length(spark):
    symbols = sentences.Symbols({("en", "a"), ("en", ".")})
    words = ["“", "a", "."] + ["a"] * 200 + [".", "”", "a", ".", "“", "a", ".", "a", "“", "a", ".", "”", "."]
    codes = symbols.of("en", pa.array(words))
    inside = {sentences._code("q.")}
    assert [i for i, c in enumerate(codes) if c in inside] == [2, 203, 213]
    assert list(sentences.Symbols({("en", ".")}, 3).of("en", pa.array(['"', "a", "a", "a", "a", ".", '"', ".", '"']))).count(sentences._code("q.")) == 1


def test_texts_decoded_together_equal_single_ones():
    rng = np.random.default_rng(0)
    stream = np.concatenate([np.append(rng.integers(20, 26, rng.integers(2, 7)), 20) for _ in range(200)])
    held = [(o, h, g) for o, h, g in sentences.grams("en", sentences.merged(stream, stream == 20))]
    counts = {"gram_order": [], "history": [], "gram": [], "n": []}
    for o, h, g in held:
        own, at, n = np.unique(g, return_index=True, return_counts=True)
        for k, v in zip(counts, (np.full(len(own), o), h[at].view(np.int64), own.view(np.int64), n)):
            counts[k].append(v)
    model = sentences.Model({k: np.concatenate(v) for k, v in counts.items()})
    texts = [rng.integers(19, 26, n) for n in (1, 40, 0, 7, 3, 90)]
    flags = [bool(i % 2) for i in range(6)]
    together = sentences.boundaries(model, "en", texts, flags, flags[::-1])
    single = [sentences.boundaries(model, "en", [t], [a], [b]) for t, a, b in zip(texts, flags, flags[::-1])]
    assert np.allclose(together, np.concatenate(single))


def test_boundaries_without_training_or_rows(spark):
    only = corpus(spark, [(1, 1, "f", 0, "a", "en"), (2, 1, "f", None, None, "en"), (3, 1, "f", 0, "b", None)])
    assert 3 in {r["id"] for r in sentences.sentence_ends(only).collect()}
    assert sentences.sentence_ends(corpus(spark, [])).count() == 0


def test_units_cover_their_documents(spark, sf):
    c = spark.read.parquet(f"{sf}/corpus.parquet")
    units = sentences.sentence_units(c).collect()
    assert units and all(u["first_id"] <= u["last_id"] for u in units)
    by = defaultdict(list)
    for u in units:
        by[u["doc_id"]].append((u["sent_no"], u["first_id"], u["last_id"]))
    for own in by.values():
        own.sort()
        assert [k for k, _, _ in own] == list(range(1, len(own) + 1))
        assert all(b[1] == a[2] + 1 for a, b in zip(own, own[1:]))


# 3 -------------------------------------------------------------------------------------


def brute_pairs(records, min_count, min_lift):
    n_item, n_pair = Counter(), Counter()
    for items in records.values():
        n_item.update(items)
        n_pair.update(itertools.combinations(sorted(items), 2))
    n = len(records)
    return {(a, b): v for (a, b), v in n_pair.items() if v >= min_count and v * n >= min_lift * n_item[a] * n_item[b]}


@pytest.mark.parametrize(("count", "lift"), [(1, 0.0), (2, 1.5)])
def test_pairs_equal_brute_force(spark, count, lift):
    rng = random.Random(1)
    records = {k: {f"w{int(rng.expovariate(0.15))}é" for _ in range(rng.randint(0, 14))} for k in range(120)}
    rows = [(f"f{k % 3}", k, w, "x") for k, items in records.items() for w in items for _ in range(rng.randint(1, 2))]
    rows += [(None, 1, "w1", "x"), ("f", None, "w1", "x"), ("f", 1, None, "x")]
    df = spark.createDataFrame(rows, "a string, b bigint, item string, code string")
    got = {(r["item_a"], r["item_b"]): r["n_ab"] for r in cooccurrence.pair_counts(df, ["a", "b"], "item", min_count=count, min_lift=lift, slice_size=4).collect()}
    assert got == brute_pairs({k: v for k, v in records.items() if v}, count, lift)


def test_a_record_of_very_many_items(spark):
    """One record holds 200,000 items, 3,000 of them in other records too."""
    n, common = 200_000, 3_000
    hot = spark.range(n).select(F.lit(0).alias("k"), F.format_string("w%06d", F.col("id")).alias("item"))
    rest = spark.range(common).select((F.col("id") % 1000 + 1).alias("k"), F.format_string("w%06d", F.col("id")).alias("item"))
    found = cooccurrence.pair_counts(hot.unionByName(rest), ["k"], "item", min_count=2)
    assert found.count() == 3 * 1000 and found.agg(F.max("n_ab"), F.min("n_ab")).first()[:] == (2, 2)
    whole = cooccurrence.pair_counts(hot.where("item < 'w003000'").unionByName(rest), ["k"], "item", slice_size=400)
    assert whole.count() == common * (common - 1) // 2


def test_odds_ratio_and_empty_pairs(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "c")], "k bigint, item string")
    r = cooccurrence.pair_counts(df, ["k"], "item").collect()[0]
    assert r["odds_ratio"] == pytest.approx(1.5 * 1.5 / (1.5 * 0.5)) and r["lift"] == pytest.approx(1.5)
    assert cooccurrence.pair_counts(df.limit(0), ["k"], "item").count() == 0


# 4 -------------------------------------------------------------------------------------


@pytest.mark.parametrize("scale", ["sf0.1", "check_l"])
def test_subjects_of_held_out_texts(spark, scale):
    """A third of the labels is held out, the others seed the centroids, in every language
    and at two scales. The held-out labels are noisy themselves (about one in twenty); a
    subject that no seed of the language names cannot be found there. Languages with
    less than 60 seeds for seven subjects, wrong ones among them, are taken together."""
    d = f"/root/testdata/{scale}"
    documents, topic_list = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/topic_list.parquet")
    labelled = subjects.labels_of(spark.read.parquet(f"{d}/corpus.parquet"), topic_list)
    langs = {r["doc_id"]: subjects.code_of(r["lang"]) for r in documents.select("doc_id", "lang").collect()}
    want = {r["doc_id"]: r["label"] for r in labelled.where("doc_id % 3 = 1").collect()}
    seeded = {(langs.get(r["doc_id"]), r["label"]) for r in labelled.where("doc_id % 3 != 1").collect()}
    seeds = labelled.where("doc_id % 3 != 1").select("doc_id", F.col("label").alias("topic"), F.lit("en").alias("lang"), F.lit("x").alias("token"))
    got = defaultdict(set)
    for r in subjects.document_subjects(documents, seeds, topic_list).collect():
        got[r["doc_id"]].add(r["topic"])
    assert max(map(len, got.values())) <= 2
    agree = defaultdict(list)
    for doc, label in want.items():
        if doc in got and (langs[doc], label) in seeded:
            agree[langs[doc]].append(label in got[doc])
    assert len(agree) >= 9
    n_seeds = Counter(langs.get(r["doc_id"]) for r in seeds.collect())
    large = {g: own for g, own in agree.items() if n_seeds[g] >= 60}
    small = [x for g, own in agree.items() if g not in large for x in own]
    assert len(large) >= (3 if scale == "sf0.1" else 9)
    for lang, own in large.items():
        chance = 2 * (0.09 * len(own)) ** 0.5  # of a rate of 0.9 over so few
        assert sum(own) >= 0.9 * len(own) - chance, (lang, sum(own), len(own))
    assert sum(small) >= 0.8 * len(small), (sum(small), len(small))


@pytest.mark.parametrize("n", [60, 3000])
def test_no_term_is_left_out(spark, n):
    """Every term keeps its bucket and its weight, however rare and however large the
    collection is."""
    rows = [(i, f"common word{i}. Common river.", "en") for i in range(n)]
    cut = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("label", F.lit(None).cast("string"))
    cut = cut.mapInArrow(subjects._cut, subjects.CUT)
    weights = subjects.Weights(subjects._summed(cut.select("lang", "term"), 1, subjects._document_counts))
    df = weights.df["en"].array[:, 0]
    # digits part the words, so that all of them are "word"; the two others stand in every text
    assert {subjects.bucket_of(w) for w in ("common", "word", "river")} == set(np.flatnonzero(df[:-1])) and df[-1] == n
    assert set(df[df > 0]) == {n} and weights.language(np.array([subjects.bucket_of("river")])) == "en"
    rare = subjects.bucket_of("quarterback")
    one = cut.unionByName(spark.createDataFrame([(n, "a quarterback", "en", None)], "doc_id bigint, text string, lang string, label string").mapInArrow(subjects._cut, subjects.CUT))
    counted = subjects.Weights(subjects._summed(one.select("lang", "term"), 1, subjects._document_counts))
    assert counted.df["en"].array[rare, 0] == 1 and counted.idf("en")[rare] == pytest.approx(np.log((2 + n) / 2) + 1)


def test_subjects_of_edge_texts(spark):
    c = corpus(spark, [(1, 1, "f", 1, "x", "en")]).withColumn("topic", F.lit(" SPORT "))
    topic_list = spark.createDataFrame([("Sport", "d"), ("General", "d"), (None, "d")], "topic string, description string")
    rows = [(1, "A match. A goal.", "en"), (2, " ", "en"), (3, None, "en"), (4, "!!!", None), (5, "ล ค่ะ ล ครับ", None), (5, "ล ค่ะ ล ครับ", None), (None, "x y", "en")]
    documents = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, lang string, term string")
    found = [(r["doc_id"], r["topic"]) for r in subjects.document_subjects(documents, c, topic_list).collect()]
    assert sorted(found) == [(1, "General"), (4, "General"), (5, "General"), (5, "General")]
    assert subjects.document_subjects(documents.limit(0), c, topic_list).count() == 0
    shares = subjects.subject_shares(subjects.document_subjects(documents, c.limit(0), topic_list)).collect()
    assert [r["topic"] for r in shares] == ["General"]


def test_sentences_of_texts():
    cut = lambda t, g: len(subjects.Terms()(t, g))
    assert cut("It was Dronun. He left at 3.5 p.m. and slept! Well?\nYes", "en") == 4
    assert cut("家を見た。犬もいる！", "ja") == 2 and cut("a ค่ะ b ครับ", "th") == 2 and cut("यह है। वह है॥", "hi") == 2


# 5 -------------------------------------------------------------------------------------


def test_frequencies_by_hand(spark):
    rows = [(1, 1, "f", 1, "The", "en"), (1, 1, "f", 1, "The", "en"), (2, 1, "f", 1, "##", "en"), (3, 2, "f", 1, "the", "en"), (4, 3, "f", 1, None, "en"), (None, 4, "f", 1, "the", "en"), (5, 3, "f", 1, "odd", "en")]
    ref = spark.createDataFrame([(" ODD ", 3), ("odd", -9), (None, 4), ("the", 100)], "token string, freq bigint")
    got = {(r["kind"], r["term"]): (r["n"], r["df"], r["list_freq"], r["mark"]) for r in frequency.term_frequencies(corpus(spark, rows), ref).collect()}
    assert got == {("token", "the"): (2, 2, 100, "common"), ("lemma", "the"): (2, 2, 100, "common"), ("token", "##"): (1, 1, 0, "common"), ("token", "odd"): (1, 1, 3, "common"), ("lemma", "odd"): (1, 1, 3, "common")}
    assert frequency.term_frequencies(corpus(spark, []), ref).count() == 0


# 7 -------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(8))
def test_windows_hold_every_item_once_within_capacity(seed):
    rng = random.Random(seed)
    capacity = 100
    sizes = [rng.choice([rng.randint(0, 100), rng.randint(40, 60), 100, 1]) for _ in range(rng.randint(1, 120))]
    windows = packing.pack(sizes, capacity)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= capacity for w in windows)
    assert packing.pack([], 10) == [] and len(packing.pack([0, 0], 10)) == 1


def test_windows_are_filled():
    rng = random.Random(11)
    sizes = [min(1024, int(rng.lognormvariate(5, 0.8))) for _ in range(2048)]
    assert len(packing.pack(sizes, 1024)) <= -(-sum(sizes) // 1024) + 3
    assert sorted(map(sorted, packing.pack([5, 30, 4], 10))) == [[0, 2], [1]]


def test_differencing_is_near_equal():
    rng = random.Random(4)
    sizes = [rng.randint(1, 60) for _ in range(300)]
    sums = [sum(sizes[i] for i in w) for w in packing.difference(sizes, 20)]
    assert len(sums) == 20 and max(sums) - min(sums) <= 3


LIMITS = "limit_name string, purpose string, max_tokens int, overlap_tokens int"


def test_packing_of_documents(spark):
    texts = ["word " * n for n in (5, 30, 70, 200, 1)] + ["", None]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "a", "x")], "doc_id bigint, text string, piece string")
    limits = spark.createDataFrame([("small", "pack", 64, None), ("bad", "pack", None, None), ("other", "split", 9, 1)], LIMITS)
    packed = packing.pack_documents(docs, limits, vocabulary=VOCABULARY).collect()
    fill = Counter()
    for r in packed:
        fill[r["container"]] += r["n_tokens"]
    assert max(fill.values()) <= 64 and {r["doc_id"] for r in packed} == set(range(6))
    assert {r["doc_id"] for r in packed if r["piece"] > 0} == {2, 3}
    assert packing.packing_report(packing.pack_documents(docs, limits, vocabulary=VOCABULARY)).collect()[0]["items"] == len(packed)
    assert packing.pack_documents(docs, limits.limit(0), vocabulary=VOCABULARY).count() == 0 and packing.pack_documents(docs.limit(0), limits, vocabulary=VOCABULARY).count() == 0


# 8 -------------------------------------------------------------------------------------


def test_fm_index_equals_scanning():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 400):
        s = rng.integers(1, 6, n)
        index = fm_index.FMIndex(s, 6, step=4)
        phrases = np.array(list(itertools.product(range(1, 6), repeat=2)))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            want = [i for i in range(n - 1) if tuple(s[i : i + 2]) == tuple(p)]
            assert sorted(index.locate(np.arange(a, b))) == want


def test_planted_passages_are_found(spark, monkeypatch):
    monkeypatch.setattr(contamination, "SHARD", 500)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(words) for _ in range(40)] for _ in range(12)]
    ja = "神社の話はこれで終わりですが家について犬の報告を書いた人は昨日から来ていないと聞いて驚いた"
    items = spark.createDataFrame([(i, " ".join(p), "q") for i, p in enumerate(passages)] + [(50, ja, "q"), (51, None, "q"), (52, "a b", "q")], "item_id bigint, passage string, question string")
    docs, want = [], set()
    for d in range(60):
        filler = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        k = rng.randrange(12)
        kind = d % 5
        cut = {0: passages[k], 1: passages[k][10:34], 2: list(passages[k]), 3: passages[k][5:17], 4: []}[kind]
        if kind == 2:
            for j in range(3, 40, 9):
                cut[j] = "changed"
        text = " ".join(filler) + "\n<p>" + ", ".join(w.upper() if j % 3 else f"<b>{w}</b>" for j, w in enumerate(cut)) + "</p>. " + " ".join(filler[::-1])
        docs.append((d, text, "x"))
        if kind in (0, 1, 2):
            want.add((d, k))
    docs += [(100, "前置き。" + ja[:30] + " 終", "x"), (101, None, "x"), (102, "", "x"), (100, "前置き。" + ja[:30] + " 終", "x")]
    want.add((100, 50))
    df = spark.createDataFrame(docs, "doc_id bigint, text string, code string")
    found = contamination.contained_items(df, items)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want
    assert contamination.contained_items(df, items.limit(0)).count() == 0 and contamination.contained_items(df.limit(0), items).count() == 0
    spans = contamination.removal_spans(df, items).where("doc_id = 0").collect()
    assert len(spans) == 1 and spans[0]["char_end"] <= len(docs[0][1])
    monkeypatch.setattr(contamination, "PASS", 1_000)
    monkeypatch.setattr(contamination, "HITS", 50)
    monkeypatch.setattr(contamination, "CELLS", 3_000)
    assert {(r["doc_id"], r["item_id"]) for r in contamination.contained_items(df, items).collect()} == want


def brute_stretches(passages, docs, share, other):
    found = set()
    for k, p in enumerate(passages):
        half = -(-len(p) * share // 1)
        for d, w in enumerate(docs):
            for diagonal in range(1 - len(p), len(w)):
                low, high = max(0, -diagonal), min(len(p), len(w) - diagonal)
                wrong = [0, *itertools.accumulate(p[i] != w[diagonal + i] for i in range(low, high))]
                if any(wrong[e] - wrong[s] <= contamination.allowed(e - s, other) for s in range(len(wrong)) for e in range(s + int(half), len(wrong))):
                    found.add((d, k))
                    break
    return found


@pytest.mark.parametrize("other", [0.125, 0.15])
def test_no_stretch_is_lost(other):
    """Passages of 4 to 60 words: halves with as many other words as are allowed, at
    random places, at the ends and next to each other, all of them found; what is found
    besides is found by brute force too."""
    rng = random.Random(int(other * 1000))
    passages, docs, want = [], [], set()
    for n in [*range(4, 61), *range(4, 61, 3)]:
        passages.append([f"p{rng.randrange(3 * n)}" for _ in range(n)])
    for k, p in enumerate(passages):
        half = -(-len(p) // 2)
        for kind in range(6):
            size = rng.choice([half, half, rng.randint(half, len(p))])
            start = rng.randint(0, len(p) - size)
            copy = p[start : start + size]
            n = contamination.allowed(size, other)
            spots = {0: range(n), 1: range(size - n, size), 2: [0, *range(size - n + 1, size)][:n], 3: [int((i + 1) * size / (n + 1)) for i in range(n)]}.get(kind, rng.sample(range(size), n))
            for i in spots:
                copy[i] = f"x{i}"
            docs.append([f"f{rng.randrange(50)}" for _ in range(rng.randint(0, 5))] + copy + [f"f{rng.randrange(50)}" for _ in range(rng.randint(0, 5))])
            want.add((len(docs) - 1, k))
        docs.append(p[: half - 1] + ["y"] * 3)
    items = contamination.Items([(i, " ".join(p)) for i, p in enumerate(passages)], 0.5, other)
    got = {(d, k) for d, k, *_ in contamination.Shard(items, docs).found()}
    assert want <= got
    assert got == brute_stretches(passages, docs, 0.5, other)


def test_many_short_passages_in_one_pass(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(words) for _ in range(rng.randint(8, 14))] for _ in range(10_000)]
    docs = [[rng.choice(words) for _ in range(40)] for _ in range(30)]
    for i in range(0, 30, 3):
        docs[i][10 : 10 + len(passages[i * 7])] = passages[i * 7]
    items = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(passages)], "item_id bigint, passage string")
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contamination.contained_items(df, items).collect()}
    assert {(i, i * 7) for i in range(0, 30, 3)} <= got


def test_spans_hold_through_normalising(spark):
    passage = "the old lamp of the river house stood beside the quiet garden wall until morning came"
    inner = passage.replace("lamp of", "<b>la</b>mp&nbsp;of").replace("quiet", "ｑｕｉｅｔ").replace("river", "RIVER")
    heads = ("Q&amp;A ", "½ cup ", "´ ", "ｶﾞｯｺｳ ", "น้ำคำ ", "&eacutet ", "İstanbul ", "e\u0301 &lt;x&gt; ", "plain ")
    docs = spark.createDataFrame([(i, h + inner + " &frac12; end") for i, h in enumerate(heads)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, passage)], "item_id bigint, passage string")
    got = {r["doc_id"]: (r["char_start"], r["char_end"], r["items"]) for r in contamination.removal_spans(docs, items).collect()}
    assert got == {i: (len(h), len(h) + len(inner), [7]) for i, h in enumerate(heads)}


def test_spans_are_those_of_the_units():
    rng = random.Random(3)
    parts = ["a", "B", " ", "&amp;", "&nbsp;", "&notit;", "&eacutet", "&#x41;", "&", ";", "½", "´", "\u0301", "\u0323", "ｶ", "ﾞ", "ำ", "İ", "Σ", "ᄀ", "ᅡ", "ᆨ", "漢", "ﷺ", "<b>", "</b>", "<p>", "<", "ো", "\u09be", "\u09c7", "…", "_", "ﬁ", "ﾡ", "ￂ"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        spans = contamination.unit_spans(text)
        assert len(spans) == len(contamination.units(text)), text
        assert all(0 <= a < b <= len(text) for a, b in spans), text


# 9 -------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit,overlap", [(16, 0), (16, 5), (50, 8), (7, 100)])
def test_pieces_cover_the_text(limit, overlap):
    enc = tokenizer(VOCABULARY)
    rng = random.Random(limit)
    texts = ["One two three. Four five six!\n\n" * 30, "漢字かな交じり文。" * 60, "x" * 700, "a\n" * 200, "🙂é" * 120, "word " * 300, "".join(rng.choice("ab .\n漢🙂") for _ in range(800))]
    for text in texts:
        pieces = splitting.split(text, limit, overlap, VOCABULARY)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        for a, b in zip(pieces, pieces[1:]):
            assert a[0] < b[0] <= a[1] < b[1]
            if overlap == 0:
                assert b[0] == a[1]
        assert all(n == len(enc.encode_ordinary(text[i:j])) and n <= limit for i, j, n, _ in pieces)


@pytest.mark.parametrize("mark,kind,share", [("。", "sentence", 0.6), ("，", "clause", 0.7), ("。", "sentence", 0.3)])
def test_a_boundary_comes_before_a_hard_cut(mark, kind, share):
    enc, limit, first = tokenizer(VOCABULARY), 100, "川"
    while len(enc.encode_ordinary(first + "川" + mark)) <= share * limit:
        first += "川"
    pieces = splitting.split(first + mark + "山" * 200, limit, 10, VOCABULARY)
    assert (pieces[0][1], pieces[0][3]) == (len(first) + 1, kind)
    assert {p[3] for p in pieces[1:-1]} <= {"hard"} and all(p[2] <= limit for p in pieces)


def test_pieces_of_documents(spark):
    docs = spark.createDataFrame([(1, "A first sentence here. " * 40, 5), (2, "short", 5), (3, None, 5), (4, "", 5), (1, "A first sentence here. " * 40, 5)], "doc_id bigint, text string, piece int")
    limits = spark.createDataFrame([("fine", "split", 50, 5), ("none", "split", 50, None), ("bad", "split", -1, 3), ("pack", "pack", 10, None)], LIMITS)
    got = splitting.split_documents(docs, limits, vocabulary=VOCABULARY).collect()
    assert {r["doc_id"] for r in got} == {1} and {r["limit_name"] for r in got} == {"fine", "none"}
    assert all(r["n_tokens"] <= 50 for r in got) and {r["cut"] for r in got} <= {"sentence", "end", "space"}
    assert splitting.split_documents(docs, limits, limit_name="fine", vocabulary=VOCABULARY).count() < len(got)
    assert splitting.split_documents(docs.limit(0), limits, vocabulary=VOCABULARY).count() == 0 and splitting.split_documents(docs, limits.limit(0), vocabulary=VOCABULARY).count() == 0


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "The long story goes on. " * 60_000)], "doc_id bigint, text string")
    limits = spark.createDataFrame([("hard", "split", 4096, 128)], LIMITS)
    assert splitting.split_documents(docs, limits, vocabulary=VOCABULARY).agg(F.max("n_tokens")).first()[0] <= 4096
