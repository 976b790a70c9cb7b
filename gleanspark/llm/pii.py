"""PII: base patterns seed a bootstrapped contextual extraction.

Base entities (e-mail, IP, card, phone) are found by pattern and check.  They are the seeds of a graph between lexical
patterns (the one or two words left of a mention, and the words on either side) and instances (what stands there).  In every
round a pattern's support is the number of different instances of high confidence, and its confidence in a kind looks only at
mentions of the kind's shape: known ones count for it with their confidence; instances of another kind count against it; unseen
ones, which say little, count a tenth against it.  Unseen mentions of a form (the sequence of letters, digits and signs) that
stands mostly after words without support are likelier plain numbers: they count neither way and are never taken.  Patterns
strong in both give the other instances they hold the noisy-or of their confidences.  So what one round discovers supports the
patterns of the next, and later rounds ask for less confidence.  After the last round the mentions that strong patterns hold
are added to the base ones, each under its likeliest kind.

Only DataFrame functions are used, and the time is linear in a text but for running sums, which take the power 3/2 of its
number of matches at a small factor.  Positions count code points.  Words with a digit or an @ stand in contexts as one
sign.  Defined cases: a null text counts as empty; rows that repeat are separate rows with the same result; a null doc_id is
kept; texts of any length are read whole; of kinds equally likely the first in order is taken; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.llm.common import once, stored

#: The kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_BLANK, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: A word that holds a digit or @, with the numbers that follow after single blanks.
MENTION = rf"(?<!{_WORD}){_WORD}*[0-9@]{_WORD}*+(?:\x20[0-9(][0-9().-]*+)*+"
#: The confidence a strong pattern has, by round; how many different instances of how much confidence support it.
BARS, LEAST_SEEDS, LEAST_CONFIDENCE = (0.7, 0.6, 0.5), 3, 0.7
#: How much an unseen mention counts against a pattern, and the least share of a form's mentions that stands in company.
UNSEEN, LEAST_COMPANY = 0.1, 0.5
#: What a mention may look like to be of a kind: an @ inside, groups of an address, enough digits.
SHAPES = {"email": r"[^@]@[^@]", "ip": r"^[0-9A-Fa-f]*(?:[.:][0-9A-Fa-f]*){2,7}$", "card": r"^(?:[^0-9]*[0-9]){8,}[^0-9]*$", "phone": r"^(?:[^0-9]*[0-9]){6,}[^0-9]*$"}
_ID = "<id>"


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    double = lambda i: F.substr(digits, i, F.lit(1)).cast("int") * (1 + (n - i) % 2)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + double(i) - F.when(double(i) > 9, F.lit(9)).otherwise(F.lit(0)))
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(match, r"[^0-9]", "")
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(F.regexp_replace(match, r"[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _keeps(kind: str):
    return lambda x: _valid(kind, x["m"])


def _may_hold(kind: str, text: Column) -> Column:
    sign = {"email": text.contains("@"), "phone": text.contains("+")}
    return sign.get(kind, text.rlike("[0-9]"))


def running(values: Column) -> Column:
    """Sums of an array of integers from its beginning through each element, by chunks of about the root of its size."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def run(xs: Column, size: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(1), F.size(xs), size), lambda i: F.slice(xs, i, size))
        inside = F.transform(chunks, lambda c: F.transform(c, lambda _, j: total(F.slice(c, F.lit(1), j + 1))))
        before = once(F.transform(chunks, total), lambda sums: F.transform(sums, lambda _, j: total(F.slice(sums, F.lit(1), j))))
        return F.flatten(F.zip_with(inside, before, lambda c, b: F.transform(c, lambda x: x + b)))

    return once(values, lambda xs: F.when(F.size(xs) == 0, xs).otherwise(once(F.ceil(F.sqrt(F.size(xs))).cast("int"), lambda n: run(xs, n))))


def _edges_of(piece: Column) -> Column:
    """n (words of a piece between matches), first, last and the one before it; identifiers as one sign."""
    words = F.filter(F.split(piece, f"{_BLANK}+"), lambda w: w != "")
    plain = lambda w: F.when(w.rlike("[0-9@]"), F.lit(_ID)).otherwise(F.lower(w))
    return once(words, lambda ws: F.struct(F.size(ws).alias("n"), plain(F.get(ws, F.lit(0))).alias("first"), plain(F.get(ws, F.size(ws) - 1)).alias("last"), plain(F.get(ws, F.size(ws) - 2)).alias("second")))


def matches(text: Column, pattern: str, possible: Column) -> Column:
    """All matches as structs m (text), s, e (code points, end exclusive), and the words l2, l1 before and r1 after.

    The pieces between matches and the matches themselves are cut by one pattern, so their lengths give the positions.
    """
    kind = "array<struct<m:string,s:int,e:int,l2:string,l1:string,r1:string>>"
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def walk(found: Column, pieces: Column) -> Column:
        n = F.size(found)
        ends = running(F.zip_with(F.slice(pieces, F.lit(1), n), found, lambda p, m: F.length(p) + F.length(m)))

        def one(ends: Column, edges: Column) -> Column:
            def at(i: Column) -> Column:
                m, left, right = F.get(found, i), F.get(edges, i), F.get(edges, i + 1)
                far = F.get(edges, i - 1)
                l1 = F.when(left["n"] > 0, left["last"]).when(i > 0, _ID)
                l2 = F.when(left["n"] > 1, left["second"]).when((left["n"] == 1) & (i > 0), _ID).when(i > 0, F.when(far["n"] > 0, far["last"]).when(i > 1, _ID))
                r1 = F.when(right["n"] > 0, right["first"]).when(i + 1 < n, _ID)
                e = F.get(ends, i)
                return F.struct(m.alias("m"), (e - F.length(m)).alias("s"), e.alias("e"), l2.alias("l2"), l1.alias("l1"), r1.alias("r1"))

            return F.transform(F.sequence(F.lit(0), n - 1), at)

        return once(F.struct(ends.alias("e"), F.transform(pieces, _edges_of).alias("w")), lambda x: one(x["e"], x["w"]))

    # The cut texts are bound, so that they are cut once.
    bound = once(F.struct(found.alias("f"), pieces.alias("p")), lambda x: F.when(F.size(x["f"]) > 0, walk(x["f"], x["p"])).otherwise(F.array().cast(kind)))
    return F.when(possible, bound).otherwise(F.array().cast(kind))


def base_matches(docs: DataFrame) -> DataFrame:
    """(doc_id, row, email, ip, card, phone, words): the valid base matches of every row, and all words like identifiers."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    for kind in KINDS:
        df = df.withColumn(kind, F.filter(matches(F.col("text"), PATTERNS[kind], _may_hold(kind, F.col("text"))), _keeps(kind)))
    return df.withColumn("words", matches(F.col("text"), MENTION, F.col("text").rlike("[0-9@]"))).drop("text")


def _trimmed(m: Column) -> Column:
    """Without the signs around an identifier."""
    return F.regexp_replace(F.regexp_replace(m, r"^[^0-9A-Za-z@+]+", ""), r"(?<![^0-9A-Za-z])[^0-9A-Za-z]++$", "")


def mentions(base: DataFrame) -> DataFrame:
    """(doc_id, row, kind, s, e, m, patterns): base matches with their kind, other identifier-like words without."""

    def of_kind(k: str | None):
        return lambda x: F.struct(F.lit(k).cast("string").alias("kind"), *[x[c].alias(c) for c in ("s", "e", "m", "l2", "l1", "r1")])

    every = F.flatten(F.array(*[F.transform(k, of_kind(k)) for k in KINDS], F.transform("words", of_kind(None))))
    rows = base.select("doc_id", "row", F.explode(every).alias("x")).select("doc_id", "row", "x.*").distinct()
    # A word that a base match overlaps is no other mention.
    seed, other = F.col("kind").isNotNull(), F.col("kind").isNull()
    so_far = lambda *order: Window.partitionBy("doc_id", "row").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(seed, F.col("e"))).over(so_far("s", F.col("e").desc(), other))
    # Backwards, as frames that end with the partition are computed anew for each row.
    ahead = F.min(F.when(seed, F.col("s"))).over(so_far(F.col("s").desc(), "e", other.desc()))
    free = rows.withColumns({"reach": reach, "ahead": ahead}).where(seed | (F.coalesce(F.col("reach") <= F.col("s"), F.lit(True)) & F.coalesce(F.col("ahead") >= F.col("e"), F.lit(True))))
    lead = F.length(F.regexp_extract("m", r"^[^0-9A-Za-z@+]*", 0))
    s = F.when(seed, F.col("s")).otherwise(F.col("s") + lead)
    short = F.when(seed, F.col("m")).otherwise(_trimmed(F.col("m")))
    patterns = F.array_compact(F.array(F.concat(F.lit("1 "), F.col("l1")), F.concat(F.lit("2 "), F.col("l2"), F.lit(" "), F.col("l1")), F.concat(F.lit("B "), F.col("l1"), F.lit(" "), F.col("r1"))))
    return free.select("doc_id", "row", "kind", s.alias("s"), (s + F.length(short)).alias("e"), short.alias("m"), patterns.alias("patterns"))


def _shaped(kind: Column, m: Column) -> Column:
    return reduce(lambda rest, k: F.when(kind == k, m.rlike(SHAPES[k])).otherwise(rest), KINDS, F.lit(False))


def _form(m: Column) -> Column:
    """A short hash of what an identifier looks like: runs of letters (with digits) as one letter, single digits as 9."""
    return F.xxhash64(F.regexp_replace(F.regexp_replace(m, r"[0-9]*+[A-Za-z][0-9A-Za-z]*+", "a"), r"[0-9]", "9"))


@dataclass(frozen=True)
class Graph:
    """Seeds (instance, kind, confidence), edges (pattern, instance, m, form, seed, n), and the unseen mentions of each form."""

    seeds: DataFrame
    edges: DataFrame
    forms: DataFrame


def graph(found: DataFrame) -> Graph:
    """The graph of ``mentions``, with the patterns that have enough instances to get support."""
    known = found.withColumns({"instance": F.xxhash64("m"), "form": _form(F.col("m"))})
    seeds = stored(known.where("kind IS NOT NULL").groupBy("instance", "kind").agg(F.lit(1.0).alias("confidence")), "seeds")
    names = ["pattern", "instance", "m", "form", "n"]
    cells = known.select(F.explode("patterns").alias("pattern"), "instance", "m", "form").groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("m"), F.min("form").alias("form"))
    wide = cells.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances")).where(F.col("instances") >= LEAST_SEEDS).select("pattern")
    seen = seeds.select("instance", F.lit(True).alias("seed")).distinct()
    edges = stored(cells.join(wide, "pattern").join(seen, "instance", "left").select(*names, F.coalesce("seed", F.lit(False)).alias("seed")), "edges")
    forms = known.where("kind IS NULL").groupBy("instance", "form").agg(F.count(F.lit(1)).alias("n")).join(seen, "instance", "left_anti")
    return Graph(seeds, edges, stored(forms.groupBy("form").agg(F.sum("n").alias("total")), "forms"))


def _strong(g: Graph, known: DataFrame, bar: float) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, confidence) of the strong patterns, and (form, kind) in company, given (instance, kind, confidence)."""
    sure = known.where(F.col("confidence") >= LEAST_CONFIDENCE)
    supported = g.edges.join(sure, "instance").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= LEAST_SEEDS).select("pattern", "kind")
    held = g.edges.join(supported, "pattern").where(_shaped(F.col("kind"), F.col("m"))).join(known, ["instance", "kind"], "left")
    sure_of, n = F.coalesce("confidence", F.lit(0.0)), F.col("n")
    # One row for each pattern, kind and form before forms are looked up.
    sums = {"of": F.sum(n * sure_of), "other": F.sum(F.when(F.col("seed"), n * (1 - sure_of)).otherwise(0.0)), "unseen": F.sum(F.when(F.col("seed"), 0.0).otherwise(n * (1 - sure_of))), "fresh": F.sum(F.when(F.col("seed"), 0).otherwise(n))}
    cells = stored(held.groupBy("pattern", "kind", "form").agg(*[c.alias(k) for k, c in sums.items()]), "cells")
    # Longer patterns lie within those of one word, so the latter alone tell which mentions are in company.
    inside = cells.where(F.col("pattern").startswith("1 ") & (F.col("fresh") > 0)).groupBy("form", "kind").agg(F.sum("fresh").alias("inside"))
    company = stored(inside.join(g.forms, "form").where(F.col("inside") >= LEAST_COMPANY * F.col("total")).select("form", "kind"), "company")
    known_form = company.withColumn("near", F.lit(True))
    scored = cells.join(known_form, ["form", "kind"], "left").groupBy("pattern", "kind").agg(F.sum("of").alias("of"), (F.sum("other") + UNSEEN * F.sum(F.when(F.col("near"), F.col("unseen")).otherwise(0.0))).alias("against"))
    confidence = F.round(F.col("of") / (F.col("of") + F.col("against")), 9)
    return scored.select("pattern", "kind", confidence.alias("confidence")).where(F.col("confidence") >= bar), company


def _noisy_or() -> Column:
    """- log of the chance that all patterns err."""
    return -F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999))))


def scored_patterns(found: DataFrame, bars: Sequence[float] = BARS) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, confidence) of the strong patterns after all rounds, and (form, kind) of what they may take."""
    g = graph(found)
    known = g.seeds
    for bar in bars[:-1]:
        strong, company = _strong(g, known, bar)
        held = g.edges.where("NOT seed").join(strong, "pattern").where(_shaped(F.col("kind"), F.col("m"))).join(company, ["form", "kind"], "left_semi")
        gained = held.groupBy("instance", "kind").agg((1 - F.exp(-_noisy_or())).alias("confidence"))
        known = stored(g.seeds.unionByName(gained), "known")
    return _strong(g, known, bars[-1])


def discovered(base: DataFrame) -> DataFrame:
    """(doc_id, row, kind, s, e): spans that only strong patterns find, from the base matches."""
    found = stored(mentions(base), "mentions")
    strong, company = scored_patterns(found)
    good = stored(strong, "patterns")
    fresh = found.where("kind IS NULL").select("doc_id", "row", "s", "e", "m", _form(F.col("m")).alias("form"), F.explode("patterns").alias("pattern"))
    held = fresh.join(good, "pattern").where(_shaped(F.col("kind"), F.col("m"))).join(company, ["form", "kind"], "left_semi")
    scored = held.groupBy("doc_id", "row", "s", "e", "kind").agg(_noisy_or().alias("weight"))
    order = reduce(lambda rest, k: F.when(F.col("kind") == k, -KINDS.index(k)).otherwise(rest), KINDS, F.lit(-len(KINDS)))
    return scored.groupBy("doc_id", "row", "s", "e").agg(F.max_by("kind", F.struct(F.round("weight", 9), order)).alias("kind"))


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, email, ip, card, phone, extra): arrays of base spans by kind, and of discovered ``(kind, s, e)``."""
    found = stored(base_matches(docs), "base")
    spans = [F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(k) for k in KINDS]
    base = found.select("doc_id", "row", *spans)
    extra = discovered(found).groupBy(F.col("doc_id").alias("x_doc"), F.col("row").alias("x_row")).agg(F.collect_set(F.struct("kind", "s", "e")).alias("extra"))
    joined = base.join(extra, F.col("doc_id").eqNullSafe(F.col("x_doc")) & (F.col("row") == F.col("x_row")), "left")
    return joined.select("doc_id", *KINDS, F.coalesce("extra", F.array().cast("array<struct<kind:string,s:int,e:int>>")).alias("extra"))


def span_text(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, ..., base_sha256, spans): counts and texts ``kind:start:end`` by kind, then start."""

    def line(k: str):
        return lambda x: F.concat(F.lit(f"{k}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))

    def of_kind(k: str):
        return lambda x: x["kind"] == k

    base = F.flatten(F.array(*[F.transform(k, line(k)) for k in KINDS]))
    every = []
    for k in KINDS:
        more = F.transform(F.filter("extra", of_kind(k)), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
        every.append(F.transform(F.array_sort(F.concat(k, more)), line(k)))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(reduce(F.concat, every), ",").alias("spans"),
        F.size("extra").cast("long").alias("n_discovered"),
    )
