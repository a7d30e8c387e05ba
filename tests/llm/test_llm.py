"""Training-data operators against brute force, round trips and held-out accuracy."""

import math
import os
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenpipe.llm import abuse, distinct, leakage, mixing, percentiles
from lumenpipe.llm.text import word_spans, words


def nearest_rank(values, per_mille):
    v = sorted(values)
    return v[max(1, -(-len(v) * per_mille // 1000)) - 1]


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_percentiles_by_bisection(spark, kind):
    rnd = random.Random(5)
    make = {"bigint": lambda: rnd.choice([rnd.randrange(-50, 50), int(rnd.lognormvariate(18, 4)), 2**62]), "double": lambda: rnd.choice([rnd.gauss(0, 1e-3), rnd.gauss(0, 1e9), float("inf"), 0.0])}[kind]
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([1, 2]), make()) for _ in range(3000)]
    rows += [("single", 1, 7 if kind == "bigint" else 7.0), ("none", 1, None), ("a", 1, None)]
    rows += [("hot", 1, rows[0][2])] * 2000
    df = spark.createDataFrame(rows, f"g string, day int, v {kind}")
    if kind == "double":
        df = df.unionByName(df.limit(1).withColumn("v", F.lit(float("nan"))))
    partial = percentiles.partial_counts(df, ["day", "g"], "v")
    got = percentiles.percentiles_by_bisection(df, percentiles.combine(partial, ["g"]), ["g"], "v", [0, 500, 950, 990, 1000])
    result = {(r["g"], r["per_mille"]): (r["value"], r["n"]) for r in got.collect()}
    groups = {}
    for g, _, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert result == {(g, p): (nearest_rank(v, p), len(v)) for g, v in groups.items() for p in (0, 500, 950, 990, 1000)}
    rough = percentiles.approximate_percentiles(percentiles.combine(partial, ["g"]), ["g"], [500]).collect()
    for r in rough:
        exact = nearest_rank(groups[r["g"]], 500)
        assert r["low"] <= exact <= r["high"]
        if math.isfinite(exact):
            assert r["high"] - r["low"] <= percentiles.error_bound() * (1 + abs(r["high"])) * 1.001
    empty = df.limit(0)
    assert percentiles.percentiles_by_bisection(empty, percentiles.partial_counts(empty, ["g"], "v"), ["g"], "v", [500]).count() == 0


def test_percentiles_count_each_span_once(spark, tmp_path):
    from lumenpipe.llm import queries

    t = ["0" * 31 + x for x in "123"]
    rows = [(t[0], "000000000000000a", k, 1, 5, "op", 900 + k) for k in range(1, 6)]  # one span, five deliveries
    rows += [(t[0].upper() + " ", "000000000000000A", 9, 1, 5, "op", 7), (t[1], "000000000000000b", 2, 1, 5, "op", 10), (t[2], "000000000000000c", 3, 1, 5, "op", 20)]
    cols = "trace_id string, span_id string, wal_seq bigint, resource_id bigint, start_time_unix_nano bigint, name string, duration_ns bigint"
    spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/spans.parquet")
    spark.createDataFrame([(1, "shop")], "resource_id bigint, service_name string").write.parquet(f"{tmp_path}/resources.parquet")
    got = {r["per_mille"]: (r["value"], r["n"]) for r in queries.QUERIES["p3_span_percentiles"](spark, str(tmp_path)).collect()}
    assert got == {500: (20, 3), 900: (901, 3), 950: (901, 3), 990: (901, 3)}
    assert sum(r["n"] for r in queries.QUERIES["p3_span_daily_partials"](spark, str(tmp_path)).collect()) == 3


def test_distinct_counts_lie_in_their_intervals(spark, monkeypatch):
    sizes = {"tiny": 1, "small": 37, "mid": 5_000, "big": 60_000}
    rows = spark.range(0).selectExpr("'x' as g", "'y' as day", "'z' as id")
    for g, n in sizes.items():
        part = spark.range(n).selectExpr(f"'{g}' as g", "cast(id % 3 as string) as day", "concat('u', id) as id")
        rows = rows.unionByName(part).unionByName(part.limit(500))
    rows = rows.unionByName(spark.createDataFrame([(None, "0", "q"), ("tiny", "0", None)], "g string, day string, id string"))
    base = distinct.sketch(rows.repartition(5), ["g", "day"], "id", m=256)
    out = {r["g"]: r for r in distinct.estimates(distinct.merge(base, ["g"]), ["g"], m=256, confidence=0.999).collect()}
    assert set(out) == {*sizes, None}
    for g, n in {**sizes, None: 1}.items():
        assert out[g]["low"] <= n <= out[g]["high"], (g, n, out[g])
    again = distinct.sketch(rows.repartition(2), ["g"], "id", m=256)
    a = {r["g"]: r["registers"] for r in again.collect()}
    assert a == {r["g"]: r["registers"] for r in distinct.merge(base, ["g"]).collect()}
    monkeypatch.setattr(distinct, "HELD", 2)  # registers are handed on after a few groups
    few = distinct.sketch(rows.repartition(2), ["g"], "id", m=256)
    assert a == {r["g"]: r["registers"] for r in few.collect()}
    assert distinct.sketch(rows.limit(0), ["g"], "id").count() == 0


def test_distinct_estimates_are_unbiased():
    rng = np.random.RandomState(1)
    found = []
    for _ in range(60):
        s = distinct.Sketches(128)
        s.add(np.zeros(900, np.int64), rng.randint(0, 2**62, 900).astype(np.uint64))
        found.append(127 / s.rows[0].sum())
    assert abs(np.mean(found) / 900 - 1) < 4 / math.sqrt(126 * 60)
    assert 0.5 < np.std(found) / 900 * math.sqrt(126) < 1.5


def test_gamma_quantiles():
    assert abs(distinct.gamma_quantile(1, 0.5) - math.log(2)) < 1e-9
    assert abs(distinct._gamma_p(1024, distinct.gamma_quantile(1024, 0.975)) - 0.975) < 1e-9


def brute_leaks(docs, items, n):
    def grams(t):
        w = words(t or "")
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    have = {i: grams(t) for i, t in items}
    return {(d, i) for d, t in docs for i, g in have.items() if g & grams(t)}


def test_words():
    assert words("Café​-Ünïon ﬁx² STRASSE_x") == ["cafe", "union", "fix2", "strasse", "x"]
    assert words("a­b‍c") == ["abc"]
    assert words("") == []


def test_leaks_against_brute_force(spark):
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(12)] + ["É", "x1"]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, text(40)) for i in range(8)] + [(8, "short one"), (9, None), (10, "")]
    docs = []
    for d in range(60):
        t = text(rnd.randrange(0, 60))
        if d % 3 == 0:
            w = items[d % 8][1].split()
            a = rnd.randrange(0, 28)
            piece = w[a : a + rnd.choice([11, 12, 15])]
            t += " " + ", ".join(unicodedata.normalize("NFD", x.upper()) for x in piece) + "! " + text(5)
        docs.append((d, t))
    docs += [(100, None), (101, ""), (102, items[0][1] * 300)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_leaks(docs, items, 12)
    assert len(want) > 10
    assert {tuple(r) for r in leakage.leaked_items(d, i).collect()} == want
    limit, leakage.BROADCAST_GRAMS = leakage.BROADCAST_GRAMS, 0
    try:
        assert {tuple(r) for r in leakage.leaked_items(d, i).collect()} == want
    finally:
        leakage.BROADCAST_GRAMS = limit
    clean = leakage.without_leaks(d, i)
    assert clean.count() == len(docs)
    dropped = {r[0] for r in leakage.without_leaks(d, i, whole_documents=True).select("doc_id").collect()}
    assert dropped == {x for x, _ in docs} - {x for x, _ in want}
    assert leakage.leaked_items(d, i.limit(0)).count() == 0 and leakage.leaked_items(d.limit(0), i).count() == 0
    leaked = clean.join(spark.createDataFrame(sorted(want), "doc_id bigint, hit bigint").select("doc_id").distinct(), "doc_id")
    assert leakage.leaked_items(leaked, i).count() < len(want)


def test_word_spans_belong_to_the_words():
    every = "".join(chr(i) + " " for i in range(0x3000) if not 0xD800 <= i < 0xE000)
    mixed = ["Cafe\u0301-Ünïon ﬁx² STRASSE_x", "a\u00adb\u200dc ΟΔΟΣ, İx", "½ ﷺ 각 Ǆ", "plain Ascii_text 12", "", every]
    for t in mixed:
        spans = word_spans(t)
        assert len(spans) == len(words(t))
        for (a, b), w in zip(spans, words(t)):
            assert w in words(t[a:b]) or w in [x.replace("σ", "ς") for x in words(t[a:b])]
    assert word_spans("Cafe\u0301-Ünïon") == [(0, 5), (6, 11)]


def test_removal_leaves_other_text_as_it_is(spark):
    leak = "Länge Eins zwei DREI vier fünf sechs sieben acht neun zehn elf"
    before, after = "Über  alles:\n\t„Ärger“ (Nr. 7)! ", "; na\u0308chste Zeile\r\n- A_b, ½ C? "
    docs = [
        (1, before + leak.upper().replace(" ", ", ") + after), (2, before), (3, leak), (4, None),
        (5, before + leak + " zwölf" + after + leak.lower() + "."), (6, "Intro. " + unicodedata.normalize("NFD", leak[::-1] + " Z. " + leak + " zwölf") + "\n"),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame([(1, leak), (2, "x " + leak + " zwölf")], "item_id bigint, text string")
    want = {1: before + after, 2: before, 3: "", 4: None, 5: before + after + ".", 6: "Intro. " + unicodedata.normalize("NFD", leak[::-1]) + " Z. \n"}
    assert {r["doc_id"]: r["text"] for r in leakage.without_leaks(d, i).collect()} == want
    limit, leakage.BROADCAST_GRAMS = leakage.BROADCAST_GRAMS, 0
    try:
        assert {r["doc_id"]: r["text"] for r in leakage.without_leaks(d, i).collect()} == want
    finally:
        leakage.BROADCAST_GRAMS = limit


def test_mix_reaches_its_shares_in_curriculum_order(spark):
    rnd = random.Random(4)
    docs = []
    for k in range(3000):
        source = rnd.choices([" Web", "book ", "CODE", "other", None], [60, 20, 10, 5, 5])[0]
        docs.append((k, source, "token " * rnd.randrange(0, 30)))
    docs.append((9001, "book", None))
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string").withColumn("position", F.lit(1))
    targets = spark.createDataFrame(
        [("web", 0.4, 1), ("book", 0.3, 2), ("code", 0.2, 4), ("absent", 0.1, 9), ("none", None, None)],
        "source string, target_share double, max_repeats int",
    )
    report = {r["source"]: r for r in mixing.shares(d, targets).collect()}
    assert set(report) == {"web", "book", "code", "absent", "none"}
    for s, share in (("web", 4 / 9), ("book", 3 / 9), ("code", 2 / 9)):
        assert abs(report[s]["actual_share"] - share) < 0.01
        assert report[s]["passes_used"] <= report[s]["max_repeats"]
    assert report["absent"]["taken_tokens"] == 0
    rows = mixing.mix(d, targets).collect()
    positions = [r["position"] for r in rows]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] < 1
    seen = {}
    for r in rows:
        seen.setdefault((r["doc_id"], r["source"]), []).append(r["pass"])
    assert all(sorted(p) == list(range(len(p))) for p in seen.values())
    early = sum(r["n_tokens"] for r in rows if r["position"] < 0.5 and r["source"] == "code")
    late = sum(r["n_tokens"] for r in rows if r["position"] >= 0.5 and r["source"] == "code")
    assert late > 1.3 * early  # the source that repeats most rises
    for cut in (0.25, 0.5, 0.75):  # the integral of the schedule is met at every time
        plan = {r["source"]: r for r in mixing.plan(mixing.sized_documents(d), targets).where("passes > 0").collect()}
        for s, p in plan.items():
            taken = sum(r["n_tokens"] for r in rows if r["source"] == s and r["position"] < cut)
            due = p["demand"] * (cut + p["slope"] * (cut * cut - cut))
            assert abs(taken - due) <= 31
    assert mixing.mix(d.limit(0), targets).count() == 0


def test_tokenizer_counts(spark):
    d = spark.createDataFrame([(1, "a", "hello world"), (2, "a", ""), (3, "a", None), (4, "a", "<|endoftext|>")], "doc_id bigint, source string, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in mixing.with_token_counts(d).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1
    enc = mixing.encoder()
    assert enc.decode(enc.encode_ordinary("naïve Straße 123")) == "naïve Straße 123"


CLEAN = ["The {0} queue drained at {1}.", "Check the {0} before you restart {1}.", "Kill the stuck {0} job after {1} minutes.", 'The word "idiot" is banned by rule {1} of {0}.', "This stupid {0} cache ate {1} MB again."]
BAD = ["You are a worthless idiot, {0}, get lost.", "I hope you die, {0}, nobody will miss you.", "{0}, you pathetic moron, go away."]


def _corpus(n, rnd):
    texts, truth = [], []
    for _ in range(n):
        lines = [rnd.choice(CLEAN).format(rnd.choice(["alpha", "beta", "gamma"]), rnd.randrange(100)) for _ in range(rnd.randrange(2, 9))]
        bad = rnd.random() < 0.25
        if bad:
            s = rnd.choice(BAD).format(rnd.choice(["Kim", "Lee", "Max"]))
            s = rnd.choice([s, s.upper(), s.replace("i", "1"), s.replace("o", "о"), s.replace("you", "y​ou")])
            lines.insert(rnd.randrange(len(lines)), s)
        texts.append("\n".join(lines))
        truth.append(bad)
    return texts, truth


def test_abuse_model_held_out(spark):
    rnd = random.Random(11)
    texts, truth = _corpus(900, rnd)
    votes = [rnd.choice([1, 2, 3]) for _ in texts]
    bad = [sum((t if rnd.random() > 0.1 else not t) for _ in range(v)) for t, v in zip(truth, votes)]
    labels = [(k, r, "abuse" if r < b else "none") for k, (v, b) in enumerate(zip(votes, bad)) for r in range(v)][:1200]
    labels += [labels[0], (1, 9, None), (None, 1, "abuse")]
    docs = [(k, rnd.choice([" A", "a", "b", None]), t) for k, t in enumerate(texts)] + [(5000, "a", None), (5001, "b", ""), (5002, "b", "x " * 50_000)]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string").withColumn("severity", F.lit("clash"))
    forms = abuse.normal_forms(d)
    model = abuse.fit(forms, spark.createDataFrame(labels, "doc_id bigint, rater int, category string"))
    assert model.thresholds == sorted(model.thresholds)
    scored = {r["doc_id"]: r for r in abuse.score_documents(forms, model).collect()}
    assert len(scored) == len(docs)
    trained = {x[0] for x in labels}
    rest = [k for k in range(len(texts)) if k not in trained]
    assert len(rest) > 150
    found = sum(scored[k]["flagged"] and truth[k] for k in rest)
    assert found >= 0.9 * sum(truth[k] for k in rest)  # recall
    assert found >= 0.9 * sum(scored[k]["flagged"] for k in rest)  # precision
    assert not scored[5000]["flagged"] and not scored[5001]["flagged"]
    report = {r["source"]: r["n_documents"] for r in abuse.rates(abuse.score_documents(forms, model)).collect()}
    assert set(report) == {"a", "b", None} and sum(report.values()) == len(docs)
    none = spark.createDataFrame([], "doc_id bigint, rater int, category string")
    blank = abuse.fit(forms.limit(0), none)
    assert abuse.score_documents(forms, blank).where("flagged").count() == 0
    assert abuse.score_documents(forms.limit(0), model).count() == 0


def test_abuse_on_the_given_labels(spark):
    """Half of the labels (by hash) train, unanimous votes of two raters or more on the other half judge."""
    folder = "/root/testdata/sf0.1"
    if not os.path.exists(folder):
        pytest.skip("no test data")
    forms = abuse.normal_forms(spark.read.parquet(f"{folder}/documents.parquet"))
    labels = spark.read.parquet(f"{folder}/doc_labels.parquet")
    third = F.pmod(F.xxhash64("doc_id", F.lit("test")), F.lit(3))
    model = abuse.fit(forms, labels.where(third != 0))
    judged = abuse.votes_by_document(labels.where(third == 0)).where("n_votes >= 2 AND (n_bad = 0 OR n_bad = n_votes)")
    rows = judged.join(abuse.score_documents(forms, model), "doc_id").select((F.col("n_bad") > 0).alias("bad"), "flagged").collect()
    found = sum(r["bad"] and r["flagged"] for r in rows)
    assert found >= 0.95 * sum(r["flagged"] for r in rows)
    assert found >= 0.6 * sum(r["bad"] for r in rows)  # 390 labelled documents and 10 000 others; the README has the figures for more


def test_words_gain_weight_by_their_company(spark):
    bad = ["you wretched gnome", "crawl away vile toad"]
    texts = [f"all fine here today\n{bad[k % 2]}" for k in range(30)] + [f"{bad[0]}\n{bad[1]}" for _ in range(30)] + ["all fine here today\nnothing new"] * 400
    d = abuse.normal_forms(spark.createDataFrame([(k, "s", t) for k, t in enumerate(texts)], "doc_id bigint, source string, text string"))
    model = abuse.Model({"gnome": 6.0}, {}, [3.0, 4.0, 5.0])
    found = abuse.lifts(abuse.company(d, model), abuse.word_documents(d), len(texts))
    assert {"crawl", "away", "vile", "toad"} <= set(found) and not {"today", "nothing", "gnome"} & set(found)


def test_scores_of_sentences_and_clauses():
    m = abuse.Model({"ant": 1.0, "b": -3.0, "zed": 2.0}, {("ant", "zed"): 4.0}, [1.0, 2.0, 3.0])
    forms = [abuse.normal_form(t) for t in ("ant zed ant. b zed", "", "b, zed and ant", "other words")]
    totals, counts = m.sentence_scores(forms)
    assert counts.tolist() == [2, 0, 1, 1] and totals.tolist() == [7.0, -1.0, 3.0, 0.0]
    assert m.scores(forms).tolist() == [7.0, abuse.NOTHING, 3.0, 0.0]
    assert m.sentence_scores([])[0].tolist() == []


def test_obfuscated_words_have_one_normal_form():
    for text in ("You are a STUPID moron", "yоu are a st​upid m0ron", "you are a stuuuupid moron", "yöu are a st.u.p.i.d mоron"):
        assert {"stupid", "moron"} & set(abuse.normal_form(text).split())
    assert abuse.normal_form("s t u p i d you") == "stupid you" and abuse.normal_form("p.a.t.h") == "path"
    assert "*fk" in abuse.normal_form("f**k this") and abuse.normal_form("") == abuse.normal_form(" \n ") == ""
