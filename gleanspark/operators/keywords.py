"""Keywords of topics: statistical (features of words in their sentences) and semantic (likeness to the topic's vector).

Words are counted by Spark over all texts; only aggregates by topic and word reach the scoring, which is made of columns.
Neighbours and places, which have about as many groups as there are words, are counted of those words alone that bounds of all
words' scores leave among a topic's first ones; a topic that needs more takes up more.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import HashingTF, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.functions.vectors import once
from gleanspark.sources.storage import stored

#: Vocabularies up to this many words (tens of bytes each) are broadcast.
BROADCAST_WORDS = 500_000
#: Places of sentences up to which words are counted before their medians are known, and what rounding may do to bounds.
PLACES, SLACK = (3, 15, 63, 255), 1e-9
_TOKEN = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"


def _sentences(rows: DataFrame, text: str) -> DataFrame:
    """(topic_id, sentence, tokens): sentences numbered by a hash, which is enough to count them."""
    parts = rows.where("topic_id >= 0").select("topic_id", F.posexplode(F.split(F.coalesce(text, F.lit("")), r"[.!?\n]+")).alias("i", "s"), F.xxhash64("recommendation_id").alias("r"))
    return parts.select("topic_id", F.xxhash64("r", "i").alias("sentence"), "i", F.regexp_extract_all("s", F.lit(_TOKEN), F.lit(0)).alias("tokens")).where(F.size("tokens") > 0)


def _telling(word: Column) -> Column:
    """Whether a word may begin or end a keyword."""
    return ~(word.isin(StopWordsRemover.loadDefaultStopWords("english")) | (F.length(word) < 3) | word.rlike(r"^\p{N}+$"))


def _words(rows: DataFrame, text: str) -> DataFrame:
    """(topic_id, word, sentence, i, u, a, before, after): every word with its neighbours and whether its casing tells.

    Stored, as it is counted in several ways.
    """
    w = _sentences(rows, text).select("topic_id", "sentence", "i", F.posexplode("tokens").alias("p", "token"), "tokens")
    upper = F.when((F.col("p") > 0) & F.col("token").rlike(r"^\p{Lu}"), 1).otherwise(0)
    acronym = F.when(F.col("token").rlike(r"^\p{Lu}{2,}$"), 1).otherwise(0)
    near = lambda by: F.lower(F.get("tokens", F.col("p") + by))
    return stored(w.select("topic_id", F.lower("token").alias("word"), "sentence", "i", upper.alias("u"), acronym.alias("a"), near(-1).alias("before"), near(1).alias("after")), "words")


def _pairs(words: DataFrame) -> DataFrame:
    """(topic_id, word, after, n): how often each word stands before each; null where a sentence ends."""
    return words.groupBy("topic_id", "word", "after").agg(F.count(F.lit(1)).alias("n"))


def _grams(words: DataFrame) -> DataFrame:
    """(topic_id, w1, w2, n): words (w2 is null) and pairs of neighbours that neither begin nor end with a stop word."""
    pairs = _pairs(words).where(_telling(F.col("word")))
    ones = pairs.groupBy("topic_id", F.col("word").alias("w1")).agg(F.sum("n").alias("n")).select("topic_id", "w1", F.lit(None).cast("string").alias("w2"), "n")
    return ones.unionByName(pairs.where(F.col("after").isNotNull() & _telling(F.col("after"))).select("topic_id", F.col("word").alias("w1"), F.col("after").alias("w2"), "n"))


def word_scores(rows: DataFrame, text: str = "review_text") -> DataFrame:
    """(topic_id, word, score), lower is more telling: casing, position, frequency, relatedness and spread of words."""
    return _scores(_words(rows, text)).select("topic_id", "word", "score")


def _scores(w: DataFrame) -> DataFrame:
    """(topic_id, word, score) from words; every count is one of groups that were counted before."""
    key, one = ["topic_id", "word"], F.count(F.lit(1)).alias("n")
    # The median place of a word: where running counts pass the middle, by what each place adds.
    places = w.groupBy(*key, "i").agg(one, F.sum("u").alias("u"), F.sum("a").alias("a"))
    by_place = Window.partitionBy(*key)
    places = places.withColumn("upto", F.sum("n").over(by_place.orderBy("i"))).withColumn("tf", F.sum("n").over(by_place))
    past = lambda k: F.min(F.when(F.col("upto") > k, F.col("i")))
    median = (past(F.floor((F.col("tf") - 1) / 2)) + past(F.floor(F.col("tf") / 2))) / 2
    f = places.groupBy(*key).agg(F.sum("n").alias("tf"), F.sum("u").alias("tu"), F.sum("a").alias("ta"), median.alias("median"))
    f = f.join(w.groupBy(*key, "sentence").agg(one).groupBy(*key).agg(F.count(F.lit(1)).alias("in_sentences")), key)
    for side, d, n in (("before", "dl", "nl"), ("after", "dr", "nr")):
        f = f.join(w.groupBy(*key, side).agg(one).groupBy(*key).agg(F.count(side).alias(d), F.sum(F.when(F.col(side).isNotNull(), F.col("n")).otherwise(0)).alias(n)), key)
    f = stored(f, "features")
    topic = f.groupBy("topic_id").agg(F.avg("tf").alias("mean"), F.stddev_pop("tf").alias("std"), F.max("tf").alias("max"))
    sentences = w.groupBy("topic_id", "sentence").agg(one).groupBy("topic_id").agg(F.count(F.lit(1)).alias("sentences"))
    f = f.join(topic, "topic_id").join(sentences, "topic_id")
    return f.select("topic_id", "word", _score(_related(), F.col("median")).alias("score"))


def _related() -> Column:
    side = lambda d, n: F.when(F.col(n) > 0, F.col(d) / F.col(n)).otherwise(F.lit(0.0))
    return 1 + (side("dl", "nl") + side("dr", "nr")) * F.col("tf") / F.col("max")


def _score(related: Column, median: Column) -> Column:
    """A word's score, which grows with both arguments."""
    case = F.greatest("tu", "ta") / (1 + F.log(F.col("tf")))
    position = F.log(F.log(3 + median))
    frequency = F.col("tf") / (F.col("mean") + F.col("std"))
    spread = F.col("in_sentences") / F.col("sentences")
    return related * position / (case + frequency / related + spread / related)


def _raw(s1: Column, s2: Column | None, n: Column) -> Column:
    """A gram's score, lower is better; it grows with the scores of its words and falls with how often it stands."""
    return s1 / (n * (1 + (s1 + 0.0))) if s2 is None else s1 * s2 / (n * (1 + (s1 + s2)))


def _features(sentences: DataFrame) -> DataFrame:
    """(topic_id, word, tf, tu, ta, in_sentences, last, upto0, ...): counts of words, from one aggregate over the texts.

    After a sentence's tokens come its distinct words, which count sentences, and an empty one, which counts all sentences.
    """
    marked = F.concat("tokens", F.array_distinct(F.transform("tokens", lambda t: F.lower(t))), F.array(F.lit("")))
    x = sentences.select("topic_id", "i", F.size("tokens").alias("m"), F.posexplode(marked).alias("p", "token"))
    said = F.col("p") < F.col("m")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return x.groupBy("topic_id", F.lower("token").alias("word")).agg(
        count(said).alias("tf"), count(said & (F.col("p") > 0) & F.col("token").rlike(r"^\p{Lu}")).alias("tu"), count(said & F.col("token").rlike(r"^\p{Lu}{2,}$")).alias("ta"),
        count(~said).alias("in_sentences"), F.max("i").alias("last"), *[count(said & (F.col("i") <= at)).alias(f"upto{k}") for k, at in enumerate(PLACES)],
    )


def _whole(f: DataFrame) -> DataFrame:
    """The features of words with the counts of their topics."""
    words = f.where("word <> ''")
    topic = words.groupBy("topic_id").agg(F.avg("tf").alias("mean"), F.stddev_pop("tf").alias("std"), F.max("tf").alias("max"))
    # One row a topic, as for all that is broadcast below by name of the topic.
    return words.join(F.broadcast(topic.join(f.where("word = ''").select("topic_id", F.col("in_sentences").alias("sentences")), "topic_id")), "topic_id")


def _bounded(f: DataFrame) -> DataFrame:
    """(topic_id, word, tf, low, high): between what a word's score lies, whatever its neighbours and its median place are."""
    tf, low, high = F.col("tf"), F.lit(PLACES[-1] + 1), F.col("last")
    for k, at in reversed(list(enumerate(PLACES))):
        low = F.when(F.col(f"upto{k}") > F.floor((tf - 1) / 2), PLACES[k - 1] + 1 if k else 0).otherwise(low)
        high = F.when(F.col(f"upto{k}") > F.floor(tf / 2), at).otherwise(high)
    bound = _whole(f).where(_telling(F.col("word")))
    return bound.select("topic_id", "word", "tf", (_score(F.lit(1.0), low) * (1 - SLACK)).alias("low"), (_score(1 + 2 * tf / F.col("max"), high) * (1 + SLACK)).alias("high"))


def _kth(rows: DataFrame, value: str, k: int) -> DataFrame:
    """(topic_id, most): the k-th least value of each topic, infinite where there are fewer."""
    least = rows.select("topic_id", value, F.row_number().over(Window.partitionBy("topic_id").orderBy(value)).alias("i")).where(F.col("i") <= k)
    return least.groupBy("topic_id").agg(F.when(F.count(F.lit(1)) >= k, F.max(value)).otherwise(F.lit(float("inf"))).alias("most"))


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_WORDS else rows


def _best(sentences: DataFrame, f: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(topic_id, gram, raw): all of a topic's grams up to some score, at least ``k`` if it has so many; and (topic_id, most), that score.

    Words have bounds of their scores by ``f``.  A gram whose lower bound is above the k-th least of the upper bounds is not one
    of the first k, so neighbours are counted of the other words alone.
    """
    b = _bounded(f)
    most = _kth(b.withColumn("raw", _raw(F.col("high"), None, F.col("tf"))), "raw", k).join(b.groupBy("topic_id").agg(F.min("low").alias("least")), "topic_id")
    most = stored(most, "words_most")
    # A word's best gram is the pair with the topic's least word, wherever it stands.
    words = stored(b.join(F.broadcast(most), "topic_id").where(_raw(F.col("low"), F.col("least"), F.col("tf")) <= F.col("most")).select("topic_id", "word", "tf", "low", "high"), "words")
    of = lambda w: _small(words.select("topic_id", F.col("word").alias(w), F.col("low").alias(f"l{w}"), F.col("high").alias(f"h{w}"), F.col("tf").alias(f"t{w}")))
    near = sentences.select("topic_id", "tokens", F.posexplode("tokens").alias("p", "token"))
    pairs = near.select("topic_id", F.lower("token").alias("w1"), F.lower(F.get("tokens", F.col("p") + 1)).alias("w2")).where("w2 IS NOT NULL")
    # Words alone bound what is to be counted: a pair stands no more often than its rarer word.
    beaten = lambda n: _raw(F.col("lw1"), F.col("lw2"), n) > F.col("most")
    bound = lambda rows: rows.join(of("w1"), ["topic_id", "w1"]).join(of("w2"), ["topic_id", "w2"]).join(F.broadcast(most.select("topic_id", "most")), "topic_id")
    pairs = bound(pairs).where(~beaten(F.least("tw1", "tw2"))).groupBy("topic_id", "w1", "w2").agg(F.count(F.lit(1)).alias("n"))
    pairs = bound(pairs).where(~beaten(F.col("n")))
    both = [_raw(F.col(f"{c}w1"), F.col(f"{c}w2"), F.col("n")).alias(c) for c in "lh"]
    ones = words.select("topic_id", F.col("word").alias("w1"), F.lit(None).cast("string").alias("w2"), F.col("tf").alias("n"), *[_raw(F.col(c), None, F.col("tf")).alias(c[0]) for c in ("low", "high")])
    grams = stored(ones.unionByName(pairs.select("topic_id", "w1", "w2", "n", *both)), "bounded")
    most = stored(_kth(grams, "h", k), "most")
    left = stored(grams.join(F.broadcast(most), "topic_id").where("l <= most").select("topic_id", "w1", "w2", "n", "most"), "left")
    # The rest is exact: places and neighbours of the words that are left.
    some = stored(left.select("topic_id", F.col("w1").alias("word")).unionByName(left.where("w2 IS NOT NULL").select("topic_id", F.col("w2").alias("word"))).distinct(), "some")
    t = sentences.select("topic_id", "i", "tokens", F.posexplode("tokens").alias("p", "token"))
    beside = lambda by: F.lower(F.get("tokens", F.col("p") + by))
    t = t.select("topic_id", F.lower("token").alias("word"), F.col("i").cast("string").alias("place"), beside(-1).alias("before"), beside(1).alias("after")).join(_small(some), ["topic_id", "word"], "left_semi")
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("what")) for kind in ("place", "before", "after")])
    counts = stored(t.select("topic_id", "word", F.explode(kinds).alias("k")).groupBy("topic_id", "word", "k.kind", "k.what").agg(F.count(F.lit(1)).alias("n")), "counts")
    key = ["topic_id", "word"]
    e = counts.where("kind = 'place'").select(*key, F.col("what").cast("int").alias("i"), "n")
    by_word = Window.partitionBy(*key)
    e = e.withColumn("upto", F.sum("n").over(by_word.orderBy("i"))).withColumn("total", F.sum("n").over(by_word))
    past = lambda at: F.min(F.when(F.col("upto") > at, F.col("i")))
    e = e.groupBy(*key).agg(((past(F.floor((F.col("total") - 1) / 2)) + past(F.floor(F.col("total") / 2))) / 2).alias("median"))
    on = lambda kind: (F.col("kind") == kind) & F.col("what").isNotNull()
    sides = [c for kind, d, n in (("before", "dl", "nl"), ("after", "dr", "nr")) for c in (F.count(F.when(on(kind), 1)).alias(d), F.sum(F.when(on(kind), F.col("n")).otherwise(0)).alias(n))]
    scored = stored(_whole(f).join(e, key).join(counts.groupBy(*key).agg(*sides), key).select(*key, _score(_related(), F.col("median")).alias("s")), "scores")
    at = lambda w: scored.select("topic_id", F.col("word").alias(w), F.col("s").alias(f"s{w}"))
    exact = left.join(at("w1"), ["topic_id", "w1"]).join(at("w2"), ["topic_id", "w2"], "left")
    product, total = F.col("sw1") * F.coalesce("sw2", F.lit(1.0)), F.col("sw1") + F.coalesce("sw2", F.lit(0.0))
    exact = exact.withColumn("raw", product / (F.col("n") * (1 + total)))
    return stored(exact.where("raw <= most").select("topic_id", F.concat_ws(" ", "w1", "w2").alias("gram"), "raw"), "grams"), most


def keywords_statistical(rows: DataFrame, n: int = 8, text: str = "review_text", alike: float = 0.7) -> DataFrame:
    """(topic_id, rank, word, score): up to ``n`` words and pairs of each topic, higher is better, near repeats left out."""
    # Stored, as the texts are counted a few times.
    sentences = stored(_sentences(rows, text).select("topic_id", "i", "tokens"), "sentences")
    f = stored(_features(sentences), "features")
    best = Window.partitionBy("topic_id").orderBy("raw", "gram")
    similar = lambda a, b: 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    repeats = lambda kept, gram: F.exists(kept, lambda k: similar(k["gram"], gram) > alike)
    spark, state, done, k, again = rows.sparkSession, "topic_id int, kept array<struct<raw:double,gram:string>>", [], 5 * n, None
    while again is None or again:
        # Topics whose best grams repeat each other too often go on with all grams up to a higher score.
        only = lambda df: df if again is None else df.join(F.broadcast(spark.createDataFrame([(t,) for t, _ in again], "topic_id int")), "topic_id")  # noqa: B023, E731
        g, most = _best(only(sentences), only(f), k)
        finite = {r.topic_id for r in most.where(F.col("most") < float("inf")).collect()}  # one row a topic
        open_, ended = again, []
        while open_ is None or open_:
            # Topics that ran out of a list full of near repeats go on with the best of what repeats nothing they have.
            have = g.withColumn("kept", F.expr("cast(array() as array<struct<raw:double,gram:string>>)")) if open_ is None else g.join(F.broadcast(spark.createDataFrame(open_, state)), "topic_id").where(~repeats(F.col("kept"), F.col("gram")))
            top = have.withColumn("i", F.row_number().over(best)).where(F.col("i") <= 5 * n)
            listed = top.groupBy("topic_id", "kept").agg(F.sort_array(F.collect_list(F.struct("raw", "gram"))).alias("c"))
            fold = F.aggregate("c", F.col("kept"), lambda kept, x: F.when((F.size(kept) < n) & ~repeats(kept, x["gram"]), F.concat(kept, F.array(x))).otherwise(kept))
            found = [(r.topic_id, r.kept, r.full) for r in listed.select("topic_id", fold.alias("kept"), (F.size("c") == 5 * n).alias("full")).collect()]  # n words a topic
            over = {t for t, kept, full in found if len(kept) >= n or not full}
            # A topic with nothing left has no row now and keeps what it had.
            ended += [(t, kept) for t, kept in open_ or [] if t not in {f[0] for f in found}] + [(t, kept) for t, kept, _ in found if t in over]
            open_ = [(t, kept) for t, kept, _ in found if t not in over]
        again = [(t, kept) for t, kept in ended if len(kept) < n and t in finite]
        done += [(t, kept) for t, kept in ended if len(kept) >= n or t not in finite]
        k *= 16
    rows_ = spark.createDataFrame(done, state).select("topic_id", F.posexplode("kept").alias("rank", "k")).select("topic_id", "rank", F.col("k.gram").alias("word"), F.col("k.raw").alias("raw"))
    most = F.max("raw").over(Window.partitionBy("topic_id")) + 0.001
    return rows_.select("topic_id", "rank", "word", (1 - F.col("raw") / most).alias("score"))


def _buckets(words: DataFrame, features: int) -> DataFrame:
    """(word, bucket) of distinct words: where ``embed`` counts them."""
    tf = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=features).transform(words.withColumn("_w", F.array("word")))
    return tf.select("word", (F.array_position(vector_to_array("_tf"), 1.0) - 1).cast("int").alias("bucket"))


def gram_cells(first: DataFrame, grams: DataFrame, text: str, features: int) -> DataFrame:
    """(topic_id, gram, score, cells): likeness of each gram to its topic's whole text, and the few cells of its vector.

    The vectors are those of ``embed`` over all grams and whole texts, kept sparse: a gram has two words at most.
    """
    grams = stored(grams.select("topic_id", F.concat_ws(" ", "w1", "w2").alias("gram"), "w1", "w2"), "grams")
    tokens = stored(first.select("topic_id", F.explode(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+")).alias("word")).where("word <> ''").groupBy("topic_id", "word").agg(F.count(F.lit(1)).alias("n")), "tokens")
    vocabulary = tokens.select("word").union(grams.select("w1")).union(grams.select("w2")).where("word IS NOT NULL").distinct()
    buckets = stored(_buckets(vocabulary, features), "buckets")
    small = F.broadcast if buckets.count() <= BROADCAST_WORDS else (lambda df: df)
    of = lambda w, b: small(buckets.select(F.col("word").alias(w), F.col("bucket").alias(b)))
    g = grams.join(of("w1", "b1"), "w1").join(of("w2", "b2"), "w2", "left")
    counted = g.select("topic_id", "gram", F.when(F.col("b1") == F.col("b2"), F.array(F.struct(F.col("b1").alias("i"), F.lit(2.0).alias("n")))).otherwise(F.filter(F.array(F.struct(F.col("b1").alias("i"), F.lit(1.0).alias("n")), F.struct(F.col("b2").alias("i"), F.lit(1.0).alias("n"))), lambda c: c["i"].isNotNull())).alias("c"))
    counted = stored(counted, "cells")
    whole = tokens.join(of("word", "bucket"), "word").groupBy("topic_id", "bucket").agg(F.sum("n").alias("n"))
    # One number for each of ``features`` buckets.
    holds = counted.select(F.explode("c").alias("c")).select(F.col("c.i").alias("bucket")).unionByName(whole.select("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("df"))
    m = counted.count() + first.select("topic_id").distinct().count()
    idf = [0.0] * features
    for r in holds.collect():
        idf[r.bucket] = math.log((m + 1) / (r.df + 1))
    weights = F.array(*[F.lit(x) for x in idf])

    def unit(cells: Column) -> Column:
        weighted = F.transform(cells, lambda c: F.struct(c["i"].alias("i"), (c["n"] * F.get(weights, c["i"])).alias("x")))
        size = lambda cs: F.sqrt(F.aggregate(cs, F.lit(0.0), lambda s, c: s + c["x"] * c["x"]))
        scaled = lambda cs, n: F.transform(cs, lambda c: F.struct(c["i"].alias("i"), (c["x"] / n).cast("float").cast("double").alias("x")))
        return F.filter(once(weighted, lambda cs: once(size(cs), lambda n: scaled(cs, n))), lambda c: c["x"] != 0)

    topic = whole.groupBy("topic_id").agg(F.collect_list(F.struct(F.col("bucket").alias("i"), F.col("n").cast("double").alias("n"))).alias("c")).select("topic_id", F.map_from_entries(unit(F.col("c"))).alias("t"))
    # An array of ``features`` numbers for each topic.
    dense = stored(topic, "wholes").select("topic_id", F.transform(F.sequence(F.lit(0), F.lit(features - 1)), lambda i: F.coalesce(F.element_at("t", i.cast("int")), F.lit(0.0))).alias("doc"))
    dense = stored(dense, "dense")
    length = lambda cells: F.sqrt(F.aggregate(cells, F.lit(0.0), lambda s, c: s + c["x"] * c["x"]))
    v = counted.select("topic_id", "gram", unit(F.col("c")).alias("cells")).join(F.broadcast(dense.withColumn("size", F.sqrt(F.aggregate("doc", F.lit(0.0), lambda s, x: s + x * x)))), "topic_id")
    dot = F.aggregate("cells", F.lit(0.0), lambda s, c: s + c["x"] * F.get("doc", c["i"]))
    return v.withColumn("score", dot / (length("cells") * F.col("size"))).where("score > 0").select("topic_id", "gram", "score", "cells")


def keywords_semantic(rows: DataFrame, n: int = 8, texts: int = 100, diversity: float = 0.5, text: str = "review_text") -> DataFrame:
    """(topic_id, rank, word, score): words and pairs most like the topic's first ``texts`` reviews, kept diverse."""
    newest = Window.partitionBy("topic_id").orderBy(F.col("timestamp_created").desc(), "recommendation_id")
    first = rows.where("topic_id >= 0").withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= texts)
    grams = _grams(_words(first, text))
    features = 256
    # A gram has two cells at most: kept as plain columns, all that a round does is compiled.
    cell = lambda k, c: F.get("cells", F.lit(k))[c]
    cells = gram_cells(first, grams, text, features).select("topic_id", "gram", "score", *[cell(k, c).alias(f"{c}{k}") for k in (0, 1) for c in ("i", "x")])
    v = stored(cells.withColumn("size", F.sqrt(F.col("x0") * F.col("x0") + F.coalesce(F.col("x1") * F.col("x1"), F.lit(0.0)))), "likeness")
    spark, chosen = rows.sparkSession, {}
    like = lambda k: (F.col("x0") * F.get(F.get("vectors", F.lit(k)), F.col("i0")) + F.coalesce(F.col("x1") * F.get(F.get("vectors", F.lit(k)), F.col("i1")), F.lit(0.0))) / F.col("size")
    for done in range(n):
        # One more of each topic: all grams are weighed against the few that were chosen before.
        if chosen:
            state = spark.createDataFrame([(t, [c[0] for c in cs], [c[2] for c in cs]) for t, cs in chosen.items()], "topic_id int, words array<string>, vectors array<array<double>>")
            left = v.join(F.broadcast(state), "topic_id").where(~F.array_contains("words", F.col("gram")))
            value = (1 - diversity) * F.col("score") - diversity * F.greatest(*[like(k) for k in range(done)], F.lit(-1.0))
        else:
            left, value = v, F.col("score")
        best = F.min_by(F.struct("gram", "score", "i0", "x0", "i1", "x1"), F.struct(-value, -F.col("score"), "gram"))
        for r in left.groupBy("topic_id").agg(best.alias("b")).collect():
            x = np.zeros(features)
            for i, c in ((r.b.i0, r.b.x0), (r.b.i1, r.b.x1)):
                if i is not None:
                    x[i] = c
            chosen.setdefault(r.topic_id, []).append((r.b.gram, r.b.score, (x / max(np.linalg.norm(x), 1e-12)).tolist()))
    picked = [(t, i, word, score) for t, cs in chosen.items() for i, (word, score, _) in enumerate(cs)]
    return spark.createDataFrame(picked, "topic_id int, rank int, word string, score double")
