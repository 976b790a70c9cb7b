"""SQL of the registered queries, over the same tables, for a second engine to check them with."""

from __future__ import annotations

from gleanspark.functions.text import CHARACTER_LANGUAGES, LANGUAGE_NAMES

#: The review projection.
REVIEWS = """reviews AS (
    SELECT CAST(d.doc_id AS VARCHAR) AS recommendation_id, d.doc_id AS i, d.doc_id % 5 AS app_id,
        CASE WHEN d.doc_id % 20 = 0 THEN 'koreana' WHEN d.doc_id % 20 = 1 THEN 'japanese' WHEN lang = 'en' THEN 'english' WHEN lang = 'de' THEN 'german' WHEN lang = 'fr' THEN 'french' ELSE 'spanish' END AS language,
        text AS review_text,
        CAST(coalesce(quality, d.doc_id % 2) AS INTEGER) AS voted_up,
        1672531200 + (d.doc_id * 104729) % 63072000 AS timestamp_created,
        1672531200 + (d.doc_id * 104729) % 63072000 + (d.doc_id % 7) * 3600 AS timestamp_updated,
        (d.doc_id * 7919) % 6000 AS playtime_at_review, (d.doc_id * 7919) % 6000 + d.doc_id % 900 AS playtime_forever,
        CAST(d.doc_id % 3 <> 0 AS INTEGER) AS steam_purchase, CAST(d.doc_id % 10 = 0 AS INTEGER) AS received_for_free,
        CAST(d.doc_id % 6 < 2 AS INTEGER) AS written_during_early_access, CAST(d.doc_id % 9 = 0 AS INTEGER) AS primarily_steam_deck,
        (d.doc_id * 31) % 500 AS votes_up, (d.doc_id * 17) % 50 AS votes_funny,
        CAST((d.doc_id * 613) % 1000 AS DOUBLE) / 1000.0 AS weighted_vote_score, d.doc_id % 12 AS comment_count,
        CASE WHEN d.doc_id % 11 = 0 THEN -1 ELSE CAST(e.label AS INTEGER) END AS topic_id, e.embedding
    FROM documents d CROSS JOIN (SELECT greatest(count(*), 1) AS n_vectors FROM embeddings) LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id % n_vectors)"""

_CHARS = ", ".join(f"'{x}'" for x in CHARACTER_LANGUAGES)
_BLANK = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
_SHORT = f"""short AS (
    SELECT *, regexp_replace(coalesce(review_text, ''), '^{_BLANK}+|{_BLANK}+$', '', 'g') AS stripped,
        CASE WHEN language IN ({_CHARS}) THEN length(regexp_replace(coalesce(review_text, ''), '^{_BLANK}+|{_BLANK}+$', '', 'g')) < 10
        ELSE len(regexp_extract_all(coalesce(review_text, ''), '[^\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+')) < 5 END AS is_short
    FROM reviews)"""
_LONG = _SHORT + """, long AS (SELECT *, CASE WHEN voted_up = 1 THEN 'positive' ELSE 'negative' END AS sentiment FROM short WHERE NOT is_short)"""
_DATE = "(DATE '1970-01-01' + CAST(floor(timestamp_created / 86400) AS INTEGER))"
_BRACKET = "CASE WHEN playtime_at_review >= 0 AND playtime_at_review < 120 THEN '<2h' WHEN playtime_at_review >= 120 AND playtime_at_review < 600 THEN '2-10h' WHEN playtime_at_review >= 600 AND playtime_at_review < 3000 THEN '10-50h' ELSE '50h+' END"
_BRACKET_ORDER = "CASE WHEN playtime_at_review >= 0 AND playtime_at_review < 120 THEN 0 WHEN playtime_at_review >= 120 AND playtime_at_review < 600 THEN 1 WHEN playtime_at_review >= 600 AND playtime_at_review < 3000 THEN 2 ELSE 3 END"
_CELLS = f"""{_LONG},
    top AS (SELECT language, row_number() OVER (ORDER BY language) - 1 AS o FROM (SELECT language, count(*) AS n FROM long GROUP BY 1 ORDER BY n DESC, language LIMIT 10)),
    cells AS (
        SELECT 'playtime' AS axis, {_BRACKET} AS bucket, {_BRACKET_ORDER} AS bucket_order, sentiment, topic_id, voted_up FROM long
        UNION ALL SELECT 'language', l.language, top.o, sentiment, topic_id, voted_up FROM long l JOIN top ON l.language = top.language
        UNION ALL SELECT 'steam_deck', CASE WHEN primarily_steam_deck = 1 THEN 'Deck' ELSE 'Non-Deck' END, CASE WHEN primarily_steam_deck = 1 THEN 0 ELSE 1 END, sentiment, topic_id, voted_up FROM long
        UNION ALL SELECT 'purchase_type', CASE WHEN steam_purchase = 1 THEN 'Purchase' ELSE 'Free' END, CASE WHEN steam_purchase = 1 THEN 0 ELSE 1 END, sentiment, topic_id, voted_up FROM long)"""


def _with(body: str, ctes: str = REVIEWS) -> str:
    return f"WITH {ctes} {body}"


def _ids(where: str) -> str:
    return _with(f"SELECT recommendation_id, app_id FROM reviews WHERE {where}")


def _trend(key: str) -> str:
    return _with(f"SELECT app_id, {key} AS bucket, sum(CASE WHEN voted_up = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN voted_up = 1 THEN 0 ELSE 1 END) AS neg FROM reviews GROUP BY 1, 2")


def _timeline(key: str) -> str:
    return _with(
        f"SELECT period, sentiment, topic_id, n, n / total AS proportion FROM (SELECT period, sentiment, topic_id, count(*) AS n, sum(count(*)) OVER (PARTITION BY period, sentiment) AS total FROM (SELECT *, {key} AS period FROM long) GROUP BY 1, 2, 3) WHERE topic_id >= 0",
        f"{REVIEWS}, {_LONG}",
    )


def _grid(key: str, name: str) -> str:
    return _with(
        f"""SELECT g.{name}, t.topic_id, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT {name} FROM b) g
        CROSS JOIN (SELECT DISTINCT topic_id FROM b WHERE sentiment = 'negative' AND topic_id >= 0) t
        LEFT JOIN (SELECT {name}, topic_id, count(*) AS n FROM b WHERE sentiment = 'negative' AND topic_id >= 0 GROUP BY 1, 2) c ON c.{name} = g.{name} AND c.topic_id = t.topic_id""",
        f"{REVIEWS}, {_LONG}, b AS (SELECT *, {key} AS {name} FROM long)",
    )


_RUNS = REVIEWS + ", runs AS (SELECT 1 AS run, recommendation_id AS point, topic_id AS label FROM reviews UNION ALL SELECT 2, recommendation_id, CAST(i % 7 AS INTEGER) FROM reviews)"
_CENTROIDS = REVIEWS + """, cells AS (SELECT topic_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM reviews WHERE topic_id >= 0),
    centroids AS (SELECT topic_id, dim, avg(CAST(x AS DOUBLE)) AS value FROM cells GROUP BY 1, 2),
    vectors AS (SELECT topic_id, list(value ORDER BY dim) AS c FROM centroids GROUP BY 1)"""
_NAMES = ", ".join(f"('{k}', '{v}')" for k, v in LANGUAGE_NAMES.items())
_METRICS = REVIEWS + ", m AS (SELECT CAST(app_id + 2 AS INTEGER) AS k, avg(weighted_vote_score) AS separation, avg(CAST(voted_up AS DOUBLE)) AS stability, avg(CAST(received_for_free AS DOUBLE)) AS fragmentation FROM reviews GROUP BY app_id, i % 3)"
_SIZES = REVIEWS + ", s AS (SELECT app_id, language, count(*) AS n FROM reviews GROUP BY 1, 2)"
_STATS = "SELECT app_id, count(*) AS total_collected, sum(voted_up) AS positive_count, sum(1 - voted_up) AS negative_count, avg(CAST(voted_up AS DOUBLE)) AS positive_rate, count(DISTINCT language) AS n_languages FROM reviews GROUP BY app_id"
_GAMES = "SELECT app_id, 'App ' || app_id AS app_name, sum(voted_up) AS total_positive, sum(1 - voted_up) AS total_negative, count(*) AS total_reviews FROM reviews GROUP BY app_id"
_COLUMNS = "recommendation_id, app_id, language, review_text, voted_up, timestamp_created, timestamp_updated, playtime_at_review, playtime_forever, steam_purchase, received_for_free, written_during_early_access, primarily_steam_deck, votes_up, votes_funny, weighted_vote_score, comment_count"

SQL: dict[str, str] = {
    "scan_reviews": _with(f"SELECT {_COLUMNS} FROM reviews WHERE app_id = 2"),
    "get_game": _with(f"SELECT * FROM ({_GAMES}) WHERE app_id = 3"),
    "list_games": _with(f"SELECT *, row_number() OVER (ORDER BY last_fetched_at DESC, app_id) AS pos FROM (SELECT g.*, f.last_fetched_at FROM ({_GAMES}) g JOIN (SELECT app_id, max(timestamp_updated) AS last_fetched_at FROM reviews GROUP BY app_id) f ON g.app_id = f.app_id)"),
    "filter_language": _ids("language = 'german'"),
    "filter_period": _ids("timestamp_created >= 1672845387 AND timestamp_created <= 1700000000"),
    "filter_playtime": _ids("playtime_at_review >= 120 AND playtime_at_review < 600"),
    "filter_purchase": _ids("steam_purchase = 1"),
    "filter_free": _ids("received_for_free = 1"),
    "filter_conjunction": _ids("language = 'english' AND timestamp_created BETWEEN 1680000000 AND 1730000000 AND playtime_at_review >= 60 AND playtime_at_review < 5000 AND steam_purchase = 1 AND received_for_free = 0"),
    "filter_relative_period": _ids("timestamp_created >= 1735689600 - 90 * 86400"),
    "filter_bracket": _ids("playtime_at_review >= 3000"),
    "filter_sentiment": _ids("voted_up = 0"),
    "take_newest": _with("SELECT recommendation_id, pos FROM (SELECT recommendation_id, row_number() OVER (ORDER BY timestamp_created DESC, recommendation_id) AS pos FROM reviews) WHERE pos <= 100"),
    "analysis_projection": _with(
        "SELECT recommendation_id AS id, review_text AS text, voted_up = 1 AS voted_up, language, playtime_at_review AS playtime, primarily_steam_deck = 1 AS steam_deck, steam_purchase = 1 AS steam_purchase, timestamp_created AS timestamp, written_during_early_access = 1 AS early_access FROM reviews"
    ),
    "semi_delete": _with("SELECT recommendation_id FROM reviews WHERE app_id NOT IN (SELECT app_id FROM reviews WHERE app_id IN (1, 4))"),
    "upsert_games": _with(
        f"""SELECT app_id, CASE WHEN app_id IN (2, 4) THEN app_name || ' II' ELSE app_name END AS app_name, app_id + 100 AS first_fetched_at, CASE WHEN app_id >= 2 THEN 999 ELSE app_id + 100 END AS last_fetched_at,
        total_positive, total_negative, CASE WHEN app_id >= 2 THEN total_reviews + 1 ELSE total_reviews END AS total_reviews FROM ({_GAMES})"""
    ),
    "upsert_reviews": _with(
        """SELECT recommendation_id, arg_min(app_id, seq) AS app_id, arg_min(language, seq) AS language, arg_max(review_text, seq) AS review_text, arg_max(voted_up, seq) AS voted_up,
        arg_max(timestamp_updated, seq) AS timestamp_updated, arg_max(votes_up, seq) AS votes_up, arg_min(playtime_forever, seq) AS playtime_forever FROM (
        SELECT recommendation_id, app_id, language, review_text, voted_up, timestamp_updated, votes_up, playtime_forever, 1 AS seq FROM reviews WHERE app_id <= 2
        UNION ALL SELECT recommendation_id, app_id, 'changed', review_text || '!', 1 - voted_up, timestamp_updated + 60, votes_up + 1, playtime_forever, 2 FROM reviews WHERE app_id >= 2) GROUP BY 1"""
    ),
    "normalize_review": _with(
        """SELECT recommendation_id, CAST(7 AS BIGINT) AS app_id, CASE WHEN i % 5 <> 0 THEN language ELSE '' END AS language, voted_up, timestamp_created, playtime_at_review,
        CASE WHEN i % 3 <> 0 THEN playtime_forever ELSE 0 END AS playtime_forever, CASE WHEN i % 2 = 0 THEN steam_purchase ELSE 0 END AS steam_purchase, CAST(0 AS BIGINT) AS votes_up,
        CASE WHEN i % 7 = 0 THEN 0.0 ELSE weighted_vote_score END AS weighted_vote_score FROM reviews"""
    ),
    "parse_app_id": """SELECT page_id, input, CASE WHEN page_id % 4 IN (1, 2) AND input IS NOT NULL THEN CAST(page_id AS BIGINT) WHEN page_id % 4 = 0 THEN TRY_CAST(nullif(regexp_extract(input, '/app/([0-9]+)', 1), '') AS BIGINT) END AS app_id
        FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN ' ' || page_id || ' ' WHEN 2 THEN url || '/app/' || page_id || '/Name/' ELSE page_id || 'a' END AS input FROM pages)""",
    "game_stats": _with(_STATS),
    "recent_rate": _with(
        "SELECT app_id, count(*) FILTER (WHERE timestamp_created >= 1735689600 - 30 * 86400) AS recent_count, avg(CAST(voted_up AS DOUBLE)) FILTER (WHERE timestamp_created >= 1735689600 - 30 * 86400) AS recent_rate FROM reviews GROUP BY app_id"
    ),
    "trend_daily": _trend(f"strftime({_DATE}, '%Y-%m-%d')"),
    "trend_weekly": _trend(f"strftime({_DATE} - CAST(dayofweek({_DATE}) AS INTEGER), '%Y-%m-%d')"),
    "trend_monthly": _trend(f"strftime({_DATE}, '%Y-%m')"),
    "language_distribution": _with("SELECT app_id, language, n FROM (SELECT app_id, language, count(*) AS n, row_number() OVER (PARTITION BY app_id ORDER BY count(*) DESC, language) AS r FROM reviews GROUP BY 1, 2) WHERE r <= 15"),
    "rate_by_playtime": _with(
        """SELECT a.app_id, b.label, count(r.i) AS total, coalesce(avg(CAST(r.voted_up AS DOUBLE)), 0.0) AS positive_rate FROM (SELECT DISTINCT app_id FROM reviews) a
        CROSS JOIN (VALUES ('<2h', 0, 120), ('2-10h', 120, 600), ('10-50h', 600, 3000), ('50h+', 3000, 9000000000)) AS b(label, lo, hi)
        LEFT JOIN reviews r ON r.app_id = a.app_id AND r.playtime_at_review >= b.lo AND r.playtime_at_review < b.hi GROUP BY 1, 2"""
    ),
    "rate_by_language": _with("SELECT app_id, label, total, positive_rate FROM (SELECT app_id, language AS label, count(*) AS total, avg(CAST(voted_up AS DOUBLE)) AS positive_rate, row_number() OVER (PARTITION BY app_id ORDER BY count(*) DESC, language) AS r FROM reviews GROUP BY 1, 2) WHERE r <= 15"),
    "rate_by_purchase": _with(
        """SELECT app_id, 'Purchase' AS label, count(*) FILTER (WHERE steam_purchase = 1) AS total, coalesce(avg(CAST(voted_up AS DOUBLE)) FILTER (WHERE steam_purchase = 1), 0.0) AS positive_rate FROM reviews GROUP BY 1
        UNION ALL SELECT app_id, 'Free', count(*) FILTER (WHERE received_for_free = 1), coalesce(avg(CAST(voted_up AS DOUBLE)) FILTER (WHERE received_for_free = 1), 0.0) FROM reviews GROUP BY 1"""
    ),
    "rate_band": _with("SELECT app_id, language AS label, CASE WHEN avg(CAST(voted_up AS DOUBLE)) >= 0.7 THEN 'high' WHEN avg(CAST(voted_up AS DOUBLE)) >= 0.4 THEN 'middle' ELSE 'low' END AS band FROM reviews GROUP BY 1, 2"),
    "compare_metrics": _with(
        f"SELECT a.app_id AS app_a, b.app_id AS app_b, a.positive_rate * 100 AS rate_a, b.positive_rate * 100 AS rate_b, log10(a.total_collected + 1) AS log_total_a, log10(b.total_collected + 1) AS log_total_b, a.n_languages AS languages_a, b.n_languages AS languages_b FROM st a, st b WHERE a.app_id = 0 AND b.app_id = 1",
        f"{REVIEWS}, st AS ({_STATS})",
    ),
    "sentiment_counts": _with("SELECT sum(voted_up) AS positive_count, sum(1 - voted_up) AS negative_count FROM reviews"),
    "top_helpful": _with("SELECT app_id, voted_up, rn, recommendation_id, weighted_vote_score FROM (SELECT *, row_number() OVER (PARTITION BY app_id, voted_up ORDER BY weighted_vote_score DESC, recommendation_id) AS rn FROM reviews) WHERE rn <= 5"),
    "short_filter": _with("SELECT recommendation_id, is_short FROM short", f"{REVIEWS}, {_SHORT}"),
    "short_summary": _with("SELECT app_id, count(*) AS count, avg(CAST(voted_up AS DOUBLE)) AS positive_rate FROM short WHERE is_short GROUP BY 1", f"{REVIEWS}, {_SHORT}"),
    "short_phrases": _with(
        """SELECT app_id, phrase, n, rank FROM (SELECT app_id, phrase, n, row_number() OVER (PARTITION BY app_id ORDER BY n DESC, t, id, phrase) AS rank FROM (
        SELECT app_id, lower(stripped) AS phrase, count(*) AS n, min(-timestamp_created) AS t, arg_min(recommendation_id, {'t': -timestamp_created, 'i': recommendation_id}) AS id FROM short WHERE is_short AND stripped <> '' GROUP BY 1, 2)) WHERE rank <= 10""",
        f"{REVIEWS}, {_SHORT}",
    ),
    "segment_cross": _with(
        "SELECT axis, bucket, bucket_order, sentiment, topic_id, n, n / total AS proportion FROM (SELECT axis, bucket, bucket_order, sentiment, topic_id, count(*) AS n, sum(count(*)) OVER (PARTITION BY axis, bucket, sentiment) AS total FROM cells GROUP BY 1, 2, 3, 4, 5) WHERE topic_id >= 0",
        f"{REVIEWS}, {_CELLS}",
    ),
    "segment_totals": _with("SELECT axis, bucket, count(*) AS total_reviews, avg(CAST(voted_up AS DOUBLE)) AS positive_rate FROM cells GROUP BY 1, 2", f"{REVIEWS}, {_CELLS}"),
    "timeline_weekly": _timeline(f"strftime({_DATE}, '%G-W%V')"),
    "timeline_monthly": _timeline(f"strftime({_DATE}, '%Y-%m')"),
    "period_totals": _with(f"SELECT strftime({_DATE}, '%Y-%m') AS period, count(*) AS total_reviews, avg(CAST(voted_up AS DOUBLE)) AS positive_rate FROM long GROUP BY 1", f"{REVIEWS}, {_LONG}"),
    "release_phase": _with(
        """SELECT topic_id, CASE WHEN ea_proportion >= 0.05 AND post_launch_proportion >= 0.05 THEN 'persistent' WHEN ea_proportion >= 0.05 THEN 'resolved' ELSE 'new' END AS status, ea_proportion, post_launch_proportion, ea_positive_rate, post_launch_positive_rate FROM (
        SELECT topic_id, count(*) FILTER (WHERE e) / any_value(en) AS ea_proportion, count(*) FILTER (WHERE NOT e) / any_value(pn) AS post_launch_proportion, any_value(er) AS ea_positive_rate, any_value(pr) AS post_launch_positive_rate
        FROM (SELECT *, written_during_early_access = 1 AS e FROM long) CROSS JOIN (SELECT count(*) FILTER (WHERE written_during_early_access = 1) AS ne, count(*) AS na,
            avg(CAST(voted_up AS DOUBLE)) FILTER (WHERE written_during_early_access = 1) AS er, avg(CAST(voted_up AS DOUBLE)) FILTER (WHERE written_during_early_access <> 1) AS pr,
            count(*) FILTER (WHERE written_during_early_access = 1 AND voted_up <> 1) AS en, count(*) FILTER (WHERE written_during_early_access <> 1 AND voted_up <> 1) AS pn FROM long)
        WHERE sentiment = 'negative' AND topic_id >= 0 AND ne >= 50 AND ne >= na * 0.1 GROUP BY topic_id) WHERE ea_proportion >= 0.05 OR post_launch_proportion >= 0.05""",
        f"{REVIEWS}, {_LONG}",
    ),
    "segment_grid": _grid(_BRACKET, "bucket"),
    "stacked_series": _grid(f"strftime({_DATE}, '%Y-%m')", "period"),
    "first_n_per_topic": _with("SELECT topic_id, rn, recommendation_id FROM (SELECT topic_id, recommendation_id, row_number() OVER (PARTITION BY topic_id ORDER BY timestamp_created DESC, recommendation_id) AS rn FROM reviews WHERE topic_id >= 0) WHERE rn <= 5"),
    "cluster_sizes": _with("SELECT topic_id, count(*) AS n FROM reviews WHERE topic_id >= 0 GROUP BY 1"),
    "cluster_centroids": _with("SELECT topic_id, dim, round(value, 6) AS value FROM centroids", _CENTROIDS),
    "centroid_pairs": _with("SELECT a.topic_id AS a, b.topic_id AS b, round(list_cosine_similarity(a.c, b.c), 6) AS similarity FROM vectors a JOIN vectors b ON a.topic_id < b.topic_id", _CENTROIDS),
    "nearest_to_centroid": _with(
        """SELECT topic_id, recommendation_id FROM (SELECT r.topic_id, recommendation_id, row_number() OVER (PARTITION BY r.topic_id ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), c) DESC, timestamp_created DESC) AS k
        FROM reviews r JOIN vectors v ON r.topic_id = v.topic_id) WHERE k = 1""",
        _CENTROIDS,
    ),
    "fragmentation": _with("SELECT run, round(coalesce(sum(n) FILTER (WHERE n < greatest(8, ceil(total * 5 / 100))), 0) / any_value(total), 6) AS value FROM (SELECT run, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY run) AS total FROM runs GROUP BY 1, 2) GROUP BY run", _RUNS),
    "stability_ari": _with(
        """SELECT round((t - x) / ((a + b) / 2 - x), 6) AS value FROM (SELECT t, a, b, a * b / (n * (n - 1) / 2) AS x FROM
        (SELECT sum(c * (c - 1) / 2) AS t, sum(c) AS n FROM cells), (SELECT sum(c * (c - 1) / 2) AS a FROM (SELECT sum(c) AS c FROM cells GROUP BY l)), (SELECT sum(c * (c - 1) / 2) AS b FROM (SELECT sum(c) AS c FROM cells GROUP BY m)))""",
        _RUNS + ", cells AS (SELECT x.label AS l, y.label AS m, CAST(count(*) AS DOUBLE) AS c FROM runs x JOIN runs y ON x.point = y.point AND x.run < y.run GROUP BY 1, 2)",
    ),
    "silhouette": _with(
        """SELECT round(avg(CASE WHEN own IS NULL OR greatest(own, other) = 0 THEN 0 ELSE (other - own) / greatest(own, other) END), 6) AS value FROM (SELECT p, max(d) FILTER (WHERE l = m) AS own, min(d) FILTER (WHERE l <> m) AS other FROM (
        SELECT p.i AS p, p.topic_id AS l, q.topic_id AS m, avg(list_distance(CAST(p.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) AS d FROM s p JOIN s q ON p.i <> q.i GROUP BY 1, 2, 3) GROUP BY p)""",
        REVIEWS + ", s AS (SELECT * FROM reviews WHERE embedding IS NOT NULL)",
    ),
    "score_k": f"""WITH {_METRICS}, g AS (SELECT k, 0.55 * quantile_cont(separation, 0.5) + 0.35 * avg(stability) - 0.10 * avg(fragmentation) AS s FROM m GROUP BY k),
        z AS (SELECT k, s, (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) AS x FROM g), w AS (SELECT min(k) AS wk FROM z WHERE (SELECT max(x) FROM z) - x < 0.01),
        f AS (SELECT wk, (SELECT x FROM z WHERE k = wk) AS won, greatest(0.0, (SELECT x FROM z WHERE k = wk) - (SELECT max(x) FROM z WHERE k <> wk)) AS mg FROM w)
        SELECT k, round(s, 6) AS group_score, round(x, 6) AS normalised, k = wk AS is_winner, round(mg, 6) AS margin, CASE WHEN won >= 0.75 AND mg >= 0.12 THEN 'high' WHEN won >= 0.45 OR mg >= 0.05 THEN 'medium' ELSE 'low' END AS confidence FROM z, f""",
    "candidate_ks": f"WITH {_SIZES} SELECT app_id, language, n, unnest(CASE WHEN n < 20 THEN [] WHEN n < 60 THEN range(2, 5) WHEN n < 150 THEN range(3, 7) WHEN n < 300 THEN range(4, 9) ELSE range(5, 11) END)::INTEGER AS k FROM s",
    "fallback_k": f"WITH {_SIZES} SELECT app_id, language, n, CAST(greatest(2, least(8, round_even(sqrt(greatest(n, 1)) / 2, 0))) AS INTEGER) AS k FROM s",
    "topic_label": _with(
        """SELECT topic_id, coalesce(string_agg(word, ', ' ORDER BY single, rank) FILTER (WHERE place <= 3 AND word IS NOT NULL), 'Topic ' || topic_id) AS label FROM (
        SELECT *, word NOT LIKE '% %' AS single, row_number() OVER (PARTITION BY topic_id ORDER BY word NOT LIKE '% %', rank) AS place FROM (
        SELECT topic_id, rank, CASE WHEN topic_id <> 9 THEN CASE WHEN rank % 2 = 1 THEN split_part(review_text, ' ', 1) || ' ' || split_part(review_text, ' ', 2) ELSE split_part(review_text, ' ', 1) END END AS word FROM (
        SELECT topic_id, review_text, row_number() OVER (PARTITION BY topic_id ORDER BY timestamp_created DESC, recommendation_id) - 1 AS rank FROM reviews WHERE topic_id >= 0) WHERE rank < 4)) GROUP BY topic_id"""
    ),
    "topic_label_lookup": _with("SELECT topic_id, CASE WHEN topic_id < 3 THEN 'named' ELSE 'Topic ' || topic_id END AS label, count(*) AS n FROM reviews WHERE topic_id >= 0 GROUP BY 1"),
    "truncate_review": _with(
        """SELECT recommendation_id, CASE WHEN length(review_text) <= 400 THEN review_text ELSE (CASE WHEN e > 200 THEN substring(cut, 1, e + 1) ELSE cut END) || ' [...]' END AS value FROM (
        SELECT *, greatest(CASE WHEN strpos(rev, ' .') = 0 THEN -1 ELSE length(cut) - strpos(rev, ' .') - 1 END, CASE WHEN strpos(rev, ' !') = 0 THEN -1 ELSE length(cut) - strpos(rev, ' !') - 1 END,
            CASE WHEN strpos(rev, ' ?') = 0 THEN -1 ELSE length(cut) - strpos(rev, ' ?') - 1 END, CASE WHEN strpos(rev, chr(10)) = 0 THEN -1 ELSE length(cut) - strpos(rev, chr(10)) END) AS e
        FROM (SELECT *, substring(review_text, 1, 400) AS cut, reverse(substring(review_text, 1, 400)) AS rev FROM reviews))"""
    ),
    "estimate_minutes": f"WITH {_SIZES} SELECT app_id, language, n, CAST(CASE WHEN n <= 0 THEN 0 ELSE greatest(1, ceil(n / 450)) END AS BIGINT) AS value FROM s",
    "language_name": _with(f"SELECT language, coalesce(name, language) AS value, count(*) AS n FROM reviews LEFT JOIN (VALUES {_NAMES}) AS x(code, name) ON code = language GROUP BY 1, 2"),
    "event_trend": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
