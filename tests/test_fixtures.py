"""Small cases with known results."""

from __future__ import annotations

import json
import math
import re

import numpy as np
import pytest
from density_brute import density
from pyspark.sql import functions as F

from gleanspark.functions import text as T
from gleanspark.functions.time import iso_week_key, sunday_key
from gleanspark.operators import clusters, crosstab, filters, keywords, learning, stats, upsert
from gleanspark.plans import report
from gleanspark.plans.config import config_hash, load_settings, resolve_config, resolve_mode, resolve_tier, save_settings
from gleanspark.sources import reviews as S
from gleanspark.streaming import ingest as I


def one(spark, column, **values):
    row = {k: (v if v is not None else "") for k, v in values.items()}
    return spark.createDataFrame([row]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text,language,short",
    [("good game", "english", True), ("one two three four five", "english", False), ("one\ttwo three\nfour five", "english", False), ("재미있다", "koreana", True), ("아주아주아주 재미있는 게임입니다", "Koreana", False), ("   ", "english", True), ("a\x1cb c d e", "english", False)],
)
def test_short(spark, text, language, short):
    assert one(spark, T.is_short(F.col("t"), F.col("l")), t=text, l=language) is short


def test_weeks(spark):
    at = {"2024-12-30": 1735516800, "2021-01-03": 1609632000}
    assert one(spark, iso_week_key(F.col("s")), s=at["2024-12-30"]) == "2025-W01"
    assert one(spark, iso_week_key(F.col("s")), s=at["2021-01-03"]) == "2020-W53"
    assert one(spark, sunday_key(F.col("s")), s=at["2024-12-30"]) == "2024-12-29"


def test_literals(spark):
    for text, app in (("730", 730), (" 570 ", 570), ("https://store.example/app/440/Name/", 440), ("abc", None), ("", None), ("/app/", None), ("12a", None)):
        assert one(spark, S.parse_app_id(F.col("t")), t=text) == app
    sizes = spark.createDataFrame([(n,) for n in (0, 1, 8, 10, 19, 20, 59, 60, 149, 150, 299, 300, 1000)], "n int")
    tried = {r.n: r.k for r in sizes.select("n", clusters.candidate_ks(F.col("n")).alias("k")).collect()}
    assert [tried[n] for n in (19, 20, 60, 150, 300)] == [[], [2, 3, 4], [3, 4, 5, 6], [4, 5, 6, 7, 8], [5, 6, 7, 8, 9, 10]]
    assert {r.n: r.k for r in sizes.select("n", clusters.fallback_k(F.col("n")).alias("k")).collect()} == {0: 2, 1: 2, 8: 2, 10: 2, 19: 2, 20: 2, 59: 4, 60: 4, 149: 6, 150: 6, 299: 8, 300: 8, 1000: 8}
    minutes = spark.createDataFrame([(n,) for n in (-1, 0, 1, 450, 451, 3000, 5000)], "n int").select(T.estimate_minutes(F.col("n")).alias("m"))
    assert [r.m for r in minutes.collect()] == [0, 0, 1, 1, 2, 7, 12]
    words = spark.createDataFrame([(0, 0, "graphics"), (0, 1, "great story"), (0, 2, "music"), (0, 3, "good fun"), (1, 0, "crash"), (1, 1, "bugs"), (2, 0, None)], "topic_id int, rank int, word string")
    assert {r.topic_id: r.label for r in clusters.topic_labels(words).collect()} == {0: "great story, good fun, graphics", 1: "crash, bugs", 2: "Topic 2"}
    runs = [(2, 0.62, 0.91, 0.0), (2, 0.60, 0.93, 0.0), (2, 0.66, 0.90, 0.0), (3, 0.55, 0.70, 0.05), (3, 0.57, 0.72, 0.0), (4, 0.31, 0.44, 0.2), (4, 0.35, 0.48, 0.25)]
    scores = {r.k: r for r in clusters.score_k(spark.createDataFrame(runs, "k int, separation double, stability double, fragmentation double")).collect()}
    assert scores[2].is_winner and not scores[3].is_winner and scores[2].normalised == 1.0 and scores[4].normalised == 0.0 and {r.confidence for r in scores.values()} == {"high"}


def test_truncate(spark):
    text = "a" * 250 + ". " + "b" * 300
    assert one(spark, T.truncate_review(F.col("t")), t=text) == "a" * 250 + ". [...]".replace(". [", ". [")
    assert one(spark, T.truncate_review(F.col("t")), t="c" * 500) == "c" * 400 + " [...]"
    assert one(spark, T.truncate_review(F.col("t")), t="short") == "short"


def _reviews(spark, rows):
    base = dict(recommendation_id="", app_id=1, language="english", review_text="", voted_up=1, timestamp_created=0, timestamp_updated=0, playtime_at_review=0, playtime_forever=0, steam_purchase=1, received_for_free=0, written_during_early_access=0, primarily_steam_deck=0, votes_up=0, votes_funny=0, weighted_vote_score=0.0, comment_count=0)
    return spark.createDataFrame([tuple((base | r)[c] for c in S.REVIEW_COLUMNS) for r in rows], S.REVIEW_SCHEMA)


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_projection_uses_every_vector(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(S, "BROADCAST_VECTORS", broadcast)
    at = lambda name: f"{tmp_path}/{name}.parquet"
    spark.createDataFrame([(i, "a b c d e", "en") for i in (1, 601, 702)], "doc_id long, text string, lang string").write.parquet(at("documents"))
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(at("labels"))
    spark.createDataFrame([(i, [float(i)], i % 10) for i in range(700)], "vec_id long, embedding array<float>, label int").write.parquet(at("embeddings"))
    assert {r.recommendation_id: r.embedding for r in S.reviews(spark, str(tmp_path)).collect()} == {"1": [1.0], "601": [601.0], "702": [2.0]}


def test_upsert_is_idempotent_and_keeps_first(spark):
    rows = _reviews(spark, [{"recommendation_id": "a", "language": "english", "votes_up": 1}, {"recommendation_id": "b"}]).withColumn("seq", F.lit(1))
    again = _reviews(spark, [{"recommendation_id": "a", "language": "german", "votes_up": 9}, {"recommendation_id": "b"}]).withColumn("seq", F.lit(2))
    out = {r.recommendation_id: r for r in upsert.upsert_reviews(rows.union(again).union(again)).collect()}
    assert len(out) == 2 and out["a"].language == "english" and out["a"].votes_up == 9


def test_stats(spark):
    rows = _reviews(spark, [{"recommendation_id": "1"}, {"recommendation_id": "2", "language": "german"}, {"recommendation_id": "3", "voted_up": 0}])
    r = stats.game_stats(rows).first()
    assert (r.total_collected, r.positive_count, r.n_languages) == (3, 2, 2) and math.isclose(r.positive_rate, 2 / 3)
    assert stats.recent_rate(rows, 10**9).first().recent_rate is None
    assert stats.sentiment_counts(rows.where("false")).first().positive_count == 0


def test_top_helpful(spark):
    rows = _reviews(spark, [{"recommendation_id": f"r{i}", "voted_up": int(i != 4), "weighted_vote_score": s} for i, s in ((1, 0.9), (2, 0.8), (3, 0.1), (4, 0.7), (5, 0.2))])
    got = {(r.voted_up, r.rn): r.recommendation_id for r in stats.top_helpful(rows, 2).collect()}
    assert (got[1, 1], got[1, 2], got[0, 1]) == ("r1", "r2", "r4")


def test_negative_playtime(spark):
    rows = _reviews(spark, [{"recommendation_id": "1", "playtime_at_review": -5}, {"recommendation_id": "2", "playtime_at_review": 119}, {"recommendation_id": "3", "playtime_at_review": 120}]).withColumn("topic_id", F.lit(0))
    assert {r.label: r.total for r in stats.rate_by_playtime(rows).collect()} == {"<2h": 1, "2-10h": 1, "10-50h": 0, "50h+": 0}
    got = {r.bucket: r.total_reviews for r in crosstab.segment_totals(rows).where("axis = 'playtime'").collect()}
    assert got == {"<2h": 1, "2-10h": 1, "50h+": 1}


def test_filter_bounds(spark):
    rows = _reviews(spark, [{"recommendation_id": str(t), "timestamp_created": t, "playtime_at_review": t} for t in (10, 20, 30)])
    ids = lambda f: sorted(r.recommendation_id for r in filters.filter_reviews(rows, f).collect())
    assert ids(filters.ReviewFilter(period_start=10, period_end=20)) == ["10", "20"]
    assert ids(filters.ReviewFilter(playtime_min=10, playtime_max=20)) == ["10"]
    assert ids(filters.ReviewFilter(language="")) == ["10", "20", "30"]


def test_release_phases(spark):
    rows = []
    for i in range(200):
        early, negative = i < 100, i % 2 == 0
        topic = (0 if i % 4 == 0 else 1 if early else 2) if negative else 5
        rows.append({"recommendation_id": str(i), "written_during_early_access": int(early), "voted_up": int(not negative), "votes_up": topic})
    df = _reviews(spark, rows).withColumn("topic_id", F.col("votes_up").cast("int"))
    assert {r.topic_id: r.status for r in crosstab.release_phases(df).collect()} == {0: "persistent", 1: "resolved", 2: "new"}
    assert crosstab.release_phases(df.where("CAST(recommendation_id AS INT) BETWEEN 70 AND 129")).count() == 0  # 30 early ones
    assert crosstab.release_phases(df.where("false")).count() == 0


def test_centroids_and_merge(spark):
    rows = [(str(i), t, v) for i, (t, v) in enumerate([(0, [1.0, 0.0]), (0, [1.0, 0.2]), (1, [0.0, 1.0]), (1, [0.1, 1.0]), (1, [0.2, 1.0])])]
    df = spark.createDataFrame(rows, "recommendation_id string, topic_id int, embedding array<float>")
    got = {r.topic_id: [round(x, 3) for x in r.centroid] for r in clusters.centroid_vectors(df).collect()}
    assert got == {0: [1.0, 0.1], 1: [0.1, 1.0]}
    apart, info = clusters.merge_topics(df, 0.95)
    assert info["merged_topic_count"] == 2 and not info["merges"]
    near = spark.createDataFrame([("a", 0, [1.0, 0.0, 0.0]), ("b", 0, [1.0, 0.0, 0.0]), ("c", 1, [0.99, 0.1, 0.0]), ("d", 2, [0.0, 0.0, 1.0]), ("e", 2, [0.0, 0.1, 1.0]), ("f", -1, [0.0, 1.0, 0.0])], "recommendation_id string, topic_id int, embedding array<float>")
    merged, info = clusters.merge_topics(near, 0.95)
    assert {r.recommendation_id: r.topic_id for r in merged.collect()} == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 1, "f": -1}
    assert info["original_topic_count"] == 3 and info["merged_topic_count"] == 2 and len(info["merges"]) == 1


def test_clusterings():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.05, (3, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    labels = learning.lloyd(x, 3, 42)
    assert sorted(np.bincount(labels).tolist()) == [3, 3, 3] and len(set(labels[:3])) == 1
    assert learning.lloyd(x[:1], 3, 1).tolist() == [0]
    y = np.vstack([rng.normal(c, 0.1, (4, 2)) for c in ((0, 0), (9, 9))])
    found = density(y, 2)
    assert len(set(found) - {-1}) >= 2 and len(set(found[:4]) & set(found[4:]) - {-1}) == 0
    assert density(y[:1]).tolist() == [-1]
    assert learning.pairwise_silhouette(x, labels) > 0.9 and learning.pairwise_silhouette(x, np.zeros(9, int)) is None


def test_silhouette_of_a_sample(spark):
    rows = [(str(i), i % 2, [float(i % 2), i / 1000]) for i in range(40)] + [("none", 0, None)]
    df = spark.createDataFrame(rows, "recommendation_id string, topic_id int, embedding array<float>")
    value = lambda d: learning.silhouette(d).collect()[0].value
    assert value(df) > 0.9
    assert value(df.where("topic_id = 0")) is None and value(df.where("false")) is None and value(df.limit(1)) is None


def test_silhouette_of_all_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (700, 3))
    x[600:] = x[:100]  # equal vectors, some with another label
    labels = rng.integers(-1, 4, 700)
    labels[5] = 99  # a topic of one row
    df = spark.createDataFrame([(str(i), int(k), v.tolist()) for i, (k, v) in enumerate(zip(labels, x, strict=True))], "recommendation_id string, topic_id int, embedding array<double>")
    assert learning.silhouette(df).first().value == pytest.approx(learning.pairwise_silhouette(x, labels), abs=1e-9)


def _topic(spark, text):
    return spark.createDataFrame([("1", 0, 1, text)], "recommendation_id string, topic_id int, timestamp_created long, review_text string")


def test_statistical_keywords_go_on_after_near_repeats(spark):
    variants = [f"abcdefghijklmnop{a}{b}" for a in "qrstuvwx" for b in "qrstuvwx"]
    others = ["zebra", "piano", "harbour", "lightning", "mustard", "quokka", "violet", "elbow"]
    got = keywords.keywords_statistical(_topic(spark, ". ".join(variants * 5 + others))).orderBy("rank").collect()
    words = [r.word for r in got]
    assert len(words) == 8 and [r["rank"] for r in got] == list(range(8)) and len(set(words) & set(others)) == 7


def _plain_keywords(spark, df):
    """The keywords of texts without a near repeat: the best of all grams by the scores of all words."""
    w = keywords._words(df, "review_text")
    s = {(r.topic_id, r.word): r.score for r in keywords.word_scores(df).collect()}
    out = {}
    for r in keywords._grams(w).collect():
        one, two = s[r.topic_id, r.w1], s[r.topic_id, r.w2] if r.w2 else None
        raw = one / (r.n * (1 + one)) if two is None else one * two / (r.n * (1 + one + two))
        out.setdefault(r.topic_id, []).append((raw, r.w1 if two is None else f"{r.w1} {r.w2}"))
    return {t: sorted(g) for t, g in out.items()}


@pytest.mark.parametrize("places", [(3, 15, 63, 255), (0, 1)])
def test_statistical_keywords_are_those_of_all_words(spark, tables, monkeypatch, places):
    monkeypatch.setattr(keywords, "PLACES", places)
    df = S.reviews(spark, tables)
    plain = _plain_keywords(spark, df)
    sentences = keywords.stored(keywords._sentences(df, "review_text").select("topic_id", "i", "tokens"), "sentences")
    features = keywords.stored(keywords._features(sentences), "features")
    for k in (1, 40, 10**9):
        g, most = keywords._best(sentences, features, k)
        got = {}
        for r in g.collect():
            got.setdefault(r.topic_id, []).append((r.raw, r.gram))
        bound = {r.topic_id: r.most for r in most.collect()}
        assert set(got) == set(plain)
        for t, grams in plain.items():
            there, whole = {w: raw for raw, w in got[t]}, {w: raw for raw, w in grams}
            assert len(there) == len(got[t]) >= min(k, len(grams)) and max(there.values()) <= bound[t]
            assert all(raw == pytest.approx(whole[w], rel=1e-9) for w, raw in there.items())
            assert {w for w, raw in whole.items() if raw < bound[t] * (1 - 1e-8)} <= set(there)


def test_statistical_keywords_count_few_neighbours(spark, monkeypatch):
    """Neighbours are counted of the words that may be among the first, not of all."""
    rng = np.random.default_rng(1)
    made = ["".join(x) for x in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (30_060, 9))]
    words = made[:60] * 50 + made[60:]
    df, kept, store = _topic(spark, ". ".join(" ".join(x) for x in rng.permutation(words).reshape(-1, 10))), {}, keywords.stored
    monkeypatch.setattr(keywords, "stored", lambda d, name: kept.setdefault(name, []).append(store(d, name)) or kept[name][-1])
    assert keywords.keywords_statistical(df).count() == 8
    assert max(d.count() for name in ("counts", "bounded") for d in kept[name]) < len(words) / 2


def test_statistical_keywords_keep_few_pairs(spark, monkeypatch):
    """Of pairs of such words only those are counted and stored that words alone do not rule out."""
    rng = np.random.default_rng(2)
    words = ["".join(x) for x in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (400, 9))]
    df, kept, store = _topic(spark, ". ".join(" ".join(x) for x in rng.choice(words, (6000, 10)))), {}, keywords.stored
    monkeypatch.setattr(keywords, "stored", lambda d, name: kept.setdefault(name, []).append(store(d, name)) or kept[name][-1])
    assert keywords.keywords_statistical(df).count() == 8
    words, bounded = kept["words"][0].count(), kept["bounded"][0].count()
    assert words > 300 and bounded < 20 * words


def test_semantic_keywords_weigh_every_gram(spark):
    letters = "abcdefghijklmnopqrst"
    df = _topic(spark, ". ".join(f"{a}{b}{a} {b}{a}{a}{b}" for a in letters for b in letters[:15]))
    grams = keywords._grams(keywords._words(df, "review_text")).select(F.concat_ws(" ", "w1", "w2").alias("gram"))
    texts = grams.select("gram", F.col("gram").alias("t")).union(df.select(F.lit(""), "review_text"))
    v = {r.gram: np.array(r.embedding, dtype=float) for r in learning.embed(texts, "t").collect()}
    doc, names = v.pop(""), sorted(v)
    unit = np.array([v[g] / np.linalg.norm(v[g]) for g in names])
    score, chosen = unit @ doc / np.linalg.norm(doc), []
    for _ in range(8):
        value = 0.5 * score - 0.5 * (unit @ unit[chosen].T).max(1) if chosen else score.copy()
        value[chosen] = -np.inf
        chosen.append(max(range(len(names)), key=lambda i: (round(value[i], 9), round(score[i], 9), -i)))
    got = keywords.keywords_semantic(df).orderBy("rank").collect()
    assert len(names) > 200 and [round(r.score, 6) for r in got] == [round(score[i], 6) for i in chosen]


def test_recommend_k(spark):
    rng = np.random.default_rng(7)
    blobs = [(f"{s}{i}", s, rng.normal((0, 0) if i % 2 else (4, 4), 0.18).tolist()) for s in ("positive", "negative") for i in range(51)]
    few = [(f"few{i}", "few", [float(i), 0.0]) for i in range(10)]
    df = spark.createDataFrame(blobs + few, "recommendation_id string, sentiment string, embedding array<double>")
    got = {r.sentiment: r for r in learning.recommend_k(df).collect()}
    for s in ("positive", "negative"):
        assert got[s].k == 2 and got[s].confidence in ("high", "medium") and not got[s].used_fallback
        assert got[s].tested == [2, 3, 4] and got[s].reason == learning.BY_SCORES
    assert got["few"].used_fallback and got["few"].confidence == "low" and got["few"].k == 2
    assert got["few"].tested == [] and got["few"].reason == learning.BY_SIZE


def test_runs_of_the_choice_of_k(spark):
    assert [share for _, share in learning.RUNS] == [1.0, 1.0, 0.85, 0.85]
    rows = [(f"r{i}", s, [float(i)]) for i in range(1000) for s in ("positive", "negative")]
    df = spark.createDataFrame(rows, "recommendation_id string, sentiment string, embedding array<double>")
    taken = {s: {r.recommendation_id for r in learning.sampled(df, "recommendation_id", "sentiment").where(F.col("sentiment") == s).collect()} for s in ("positive", "negative")}
    assert all(len(x) == 600 for x in taken.values()) and taken["positive"] != taken["negative"]


def test_agreement_by_group(spark):
    cells = [("g", run, p, p % 2 if run < 3 else p % 3) for run in (1, 2, 3) for p in range(30)] + [("h", run, p, 0) for run in (1, 2) for p in range(5)]
    df = spark.createDataFrame(cells, "name string, run int, point int, label int")
    got = {r.name: r.value for r in clusters.stability(df, by=["name"]).collect()}
    whole = clusters.stability(df.where("name = 'g'")).first().value
    assert got["h"] == 0.0 and got["g"] == pytest.approx(whole) and 0.3 < whole < 0.4


def test_restarts_of_kmeans_keep_the_least_cost(spark):
    rng = np.random.default_rng(1)
    rows = [(str(i), rng.normal((8 * (i % 5), 8 * (i % 3)), 0.2).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "recommendation_id string, embedding array<double>")
    labels = {r.recommendation_id: r.topic_id for r in learning.kmeans_labels(df, 15).collect()}
    assert len({(i % 5, i % 3, labels[str(i)]) for i in range(150)}) == len({(i % 5, i % 3) for i in range(150)}) == len(set(labels.values()))


def test_words_at_least(spark):
    for text, n, enough in (("a b c", 3, True), ("a b", 3, False), ("  a\u3000b\u2003c  ", 3, True), ("", 1, False), ("x" * 5000 + " y", 2, True), ("a b c d", 0, True)):
        assert one(spark, T.has_words(F.col("t"), n), t=text) is enough


def test_analysis_with_missing_vectors(spark, tables):
    from gleanspark.plans.analysis import run_analysis

    reviews = S.reviews(spark, tables).withColumn("embedding", F.when(F.col("recommendation_id").cast("long") % 9 != 0, F.col("embedding")))
    events = []
    found = run_analysis(reviews, {"n_topics": 3, "topicCountMode": "manual"}, events.append)
    missing = found.labelled.where("embedding IS NULL")
    assert missing.count() > 0 and {r.topic_id for r in missing.select("topic_id").distinct().collect()} == {-1}
    assert [e["percent"] for e in events] == sorted(e["percent"] for e in events) and events[-1]["stage"] == "complete" and all(e["elapsed_ms"] >= 0 for e in events)


def test_analysis_moves_texts_once(spark, tables, monkeypatch):
    """Reviews that come from a join have their texts shuffled and stored once, not for each part of the analysis."""
    from gleanspark.plans import analysis

    reviews = S.reviews(spark, tables)
    reviews = reviews.join(reviews.select("recommendation_id").hint("merge"), "recommendation_id")
    seen, store = [], analysis.stored

    def noted(df, name):
        plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        seen.append((name, len(re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[[^\n]*\breview_text#", plan)), "review_text" in df.columns))
        return store(df, name)

    for module in (analysis, clusters, keywords, learning):
        monkeypatch.setattr(module, "stored", noted)
    found = analysis.run_analysis(reviews, {"n_topics": 3, "topicCountMode": "manual"})
    assert sum(n for _, n, _ in seen) == 1 and sum(whole for _, _, whole in seen) == 1
    ids = found.labelled.select("recommendation_id", "topic_id").collect()
    assert len({r.recommendation_id for r in ids}) == len(ids) == crosstab.long_reviews(reviews).count()
    assert sum(r.review_count for r in found.topics.select("review_count").collect()) == sum(r.topic_id >= 0 for r in ids)


def test_games_in_order_of_the_last_fetch(spark):
    games = spark.createDataFrame([(1, 5), (2, 9), (3, 5)], "app_id long, last_fetched_at long")
    assert [r.app_id for r in S.list_games(games).collect()] == [2, 1, 3]


def test_markdown_and_prompts(spark):
    rows = _reviews(spark, [{"recommendation_id": "1", "review_text": "fine"}, {"recommendation_id": "2", "voted_up": 0, "language": "german"}, {"recommendation_id": "3", "app_id": 2}])
    text = report.export_markdown(rows, 1, "Name", rows.where("voted_up = 1 AND app_id = 1"))
    assert text.startswith("# Name Review Analysis\n\n- Total Reviews: 2\n- Positive Rate: 50.0%\n- Languages: english, german\n\n## Reviews\n") and text.count("###") == 1
    assert report.export_markdown(rows, 9).startswith("# App 9 Review Analysis")
    topic = {"label": "crash", "review_count": 2, "keywords": [{"word": "crash", "score": 0.5}], "sample_reviews": ["a" * 250 + ". " + "b" * 300]}
    topics = spark.createDataFrame([("negative", 3, "crash", 2, [("crash", 0.5)], topic["sample_reviews"])], "sentiment string, topic_id int, label string, review_count long, keywords array<struct<word: string, score: double>>, samples array<string>")
    block = report.data_block(topics, {"negative": 1200})
    assert "## Negative Topics (1,200 reviews)" in block and "crash (0.5)" in block and block.endswith("(none)") and "a. [...]" in block
    assert "Topic 1 (2 reviews)" in report.label_prompt([topic], "German") and "Answer in German." in report.label_prompt([topic], "German")


def test_segment_complaints(spark):
    rows = [{"recommendation_id": str(i), "voted_up": int(i >= 9), "playtime_at_review": 60 if i < 8 else 9000, "votes_up": t} for i, t in enumerate([0, 0, 0, 1, 1, 2, 3, 3, 2, 0, 0])]
    df = _reviews(spark, rows).withColumn("topic_id", F.col("votes_up").cast("int"))
    labels = spark.createDataFrame([(0, "crash"), (1, "price")], "topic_id int, label string")
    got = {r.bucket: r.complaints for r in report.segment_complaints(crosstab.segment_cross(df), labels).collect()}
    assert got == {"<2h": ["crash (38%)", "price (25%)", "Topic 3 (25%)"], "50h+": ["Topic 2 (100%)"]}
    totals = [r.asDict() for r in crosstab.segment_totals(df).orderBy("axis", "bucket").collect()]
    assert "crash (38%), price (25%), Topic 3 (25%)" in report.segment_prompt(totals, {("playtime", b): c for b, c in got.items()})


def test_pages_with_summary(spark):
    asked, told = [], []

    def get(url):
        asked.append(url)
        return {"success": 1, "reviews": [{"recommendationid": str(len(asked))}] if len(asked) < 3 else [], "cursor": f"c+{len(asked)}", **({"query_summary": {"total_reviews": 2}} if len(asked) == 1 else {})}

    out = list(I.fetch_reviews("http://store.example/7", get, "german", progress=told.append, sleep=lambda s: None))
    assert [s for _, s in out] == [{"total_reviews": 2}, None] and told[-1] == {"fetched": 2, "total": 2, "cursor": "c+2"}
    assert "cursor=c%2B1" in asked[1] and "language=german" in asked[0] and "filter_offtopic_activity=1" in asked[0]
    with pytest.raises(OSError):
        list(I.fetch_reviews("http://store.example/7", lambda url: {"success": 0}, sleep=lambda s: None))


def test_config():
    assert resolve_tier("1", {"tier": 0}) == 1 and resolve_tier(None, {"tier": "auto"}, 1) == 1 and resolve_tier(None) == 0
    assert resolve_mode({"n_topics": "5"}, 0) == "manual" and resolve_mode({"n_topics": 1}, 0) == "auto" and resolve_mode({"n_topics": 5}, 1) == "auto"
    c = resolve_config({"n_topics": 99, "maxReviews": "10", "merge_threshold": 3, "filter": {"language": "", "playtime_min": 0}})
    assert c["n_topics"] == 20 and c["maxReviews"] == 10 and c["merge_threshold"] == 0.8 and c["filter"] == {"playtime_min": 0}
    auto = resolve_config({"topicCountMode": "auto", "n_topics": 5})
    assert config_hash(auto) == config_hash(resolve_config({"topicCountMode": "auto"})) != config_hash(c)


def test_settings_and_names(tmp_path):
    path = str(tmp_path / "settings.json")
    assert load_settings(path, {"tier": 0}) == {"tier": 0}
    save_settings(path, {"tier": "auto"})
    assert load_settings(path) == {"tier": "auto"}

    def fails(i):
        raise OSError

    assert I.app_name(7, fails) == "App 7" and I.app_name(7, lambda i: "Seven") == "Seven"


def test_exports(spark, tmp_path):
    rows = _reviews(spark, [{"recommendation_id": "1", "review_text": 'say "hi"\nthere', "playtime_at_review": 90}])
    report.export_one_csv(rows, f"{tmp_path}/one.csv")
    with open(f"{tmp_path}/one.csv", encoding="utf-8", newline="") as f:
        text = f.read()
    assert text == "﻿" + ",".join(report.CSV_COLUMNS) + '\n1,english,"say ""hi""\nthere",1,0,90,1,0,0.0'
    assert "### + [english] (2h)" in report.review_markdown(rows, "App 1", ["- Total: 1"])
    assert report.fill("[N] of [N]", {"[N]": "3"}) == "3 of [N]"
    assert report.eta_seconds(100, 1000, 5.0) is None and report.eta_seconds(200, 400, 10.0) == 10.0


def test_pages_and_ingest(spark, tmp_path):
    calls = []

    def get(cursor):
        calls.append(cursor)
        return {"reviews": [{"recommendationid": str(len(calls))}] * 2, "cursor": f"c{len(calls)}"} if len(calls) < 3 else {"reviews": []}

    assert len(list(I.pages(get, sleep=lambda s: None))) == 2 and calls == ["*", "c1", "c2"]
    source = tmp_path / "pages"
    source.mkdir()

    def page(name, rows):
        (source / name).write_text("\n".join(json.dumps(r) for r in rows))

    run = lambda: I.ingest(spark, str(source), f"{tmp_path}/log", f"{tmp_path}/check", 7).awaitTermination()
    page("1.json", [{"recommendationid": "a", "language": "english", "voted_up": True, "votes_up": 1, "weighted_vote_score": "0.5"}, {"recommendationid": "b", "weighted_vote_score": 0.25}])
    run()
    page("2.json", [{"recommendationid": "a", "language": "german", "voted_up": False, "votes_up": 4}])
    run()
    run()  # nothing new
    got = {r.recommendation_id: r for r in I.current(spark, f"{tmp_path}/check").collect()}
    assert set(got) == {"a", "b"} and got["a"].language == "english" and got["a"].votes_up == 4 and got["a"].voted_up == 0 and got["b"].weighted_vote_score == 0.25


def test_streamed_trend_equals_batch(spark, tmp_path, tables):
    events = spark.read.parquet(f"{tables}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(tables)
    q = I.event_trend(stream).writeStream.outputMode("complete").format("memory").queryName("trend").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((str(r.start), r.event_type, r.n) for r in df.collect())
    assert key(spark.table("trend")) == key(I.event_trend(events))
