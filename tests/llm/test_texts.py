from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gleanspark.llm import language_id as L
from gleanspark.llm import pieces as P
from gleanspark.llm import queries
from gleanspark.llm.sharding import Node, leaves, shard_of, shards, topology
from gleanspark.llm.token_counts import LongestMatch, token_counts, vocabulary
from gleanspark.llm.url_filter import url_filter

needs_model = pytest.mark.skipif(not os.path.exists(queries.PIECES_FILE), reason="no tokenizer file")


def greedy(word, initial, following):
    n, at, longest = 0, 0, max(map(len, initial | following))
    while at < len(word):
        known = initial if at == 0 else following
        end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in known), None)
        if end is None:
            return 0
        n, at = n + 1, end
    return n


def test_longest_match_is_greedy():
    rng = random.Random(1)
    pieces = lambda n: {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(n)}
    for _ in range(50):
        initial, following = pieces(8), pieces(8)
        a = LongestMatch(initial, following)
        for _ in range(100):
            w = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))
            assert a.count(w) == greedy(w, initial, following)


@needs_model
def test_token_counts_edge(edge, edge_rows, empty):
    initial, following = vocabulary(queries.PIECES_FILE)
    got = sorted((tuple(r) for r in token_counts(edge, initial, following).collect()), key=str)
    i, f = set(initial), set(following)
    expected = []
    for doc, t, _ in edge_rows:
        ws = [w.decode() for w in (t or "").encode().split()]
        ns = [greedy(w, i, f) for w in ws]
        expected.append((doc, len(ws), sum(n or 1 for n in ns), ns.count(0)))
    assert got == sorted(expected, key=str)
    assert token_counts(empty, initial, following).count() == 0


@needs_model
def test_pieces_are_the_librarys(small):
    import sentencepiece

    library, model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES_FILE), P.load(queries.PIECES_FILE)
    rows = P.encode(small, model, keep=["doc_id", "text"]).collect()
    assert all(r.ids == library.encode(r.text) for r in rows)


@needs_model
def test_round_trip_edge(edge, edge_rows, empty):
    model = P.load(queries.PIECES_FILE)
    out = P.decode(P.encode(edge, model, keep=["doc_id", "text", "lang"]), model, keep=["doc_id", "text", "ids"])
    rows = out.collect()
    assert len(rows) == len(edge_rows) and all(r.decoded == (r.text or "") for r in rows)
    both = P.encode_and_decode(edge, model, keep=["doc_id", "text", "lang"])
    assert both.columns == ["doc_id", "text", "lang", "ids", "decoded"] and sorted(map(str, both.select("doc_id", "text", "ids", "decoded").collect())) == sorted(map(str, out.select("doc_id", "text", "ids", "decoded").collect()))
    assert P.encode(empty, model).count() == 0 and P.encode_and_decode(empty, model).count() == 0


def test_unigram_takes_the_least_path():
    model = P.Model(("▁", "a", "b", "ab", "▁a", *[None] * 256), (-3.0, -2.0, -2.0, -1.5, -1.0, *[0.0] * 256), tuple(range(5, 261)), bpe=False)
    assert P.Transducer(model).encode("▁ab") == [4, 2]
    assert P.Transducer(model).encode("▁c") == [0, 5 + ord("c")]


def brute_parse(text: bytes, reference: bytes) -> int:
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in reference:
            size += 1
        at, n = at + size, n + 1
    return n


def folded(text: str) -> bytes:
    a = L.np.frombuffer(text.encode(), L.np.uint8)
    return L.normalise(a, L.np.array([0, len(a)]))[0].tobytes()


def test_phrases_are_the_longest_matches():
    refs = {"x": "the cat sat on the mat and ate".encode(), "y": "le chat était sur la table et mangé".encode()}
    p = L.Parser(refs)
    texts = ["the mat sat", "la table était là", "zzz the", "É été ÉTÉ", ""]
    data = L.np.frombuffer("".join(texts).encode(), L.np.uint8)
    starts = L.np.cumsum([0, *[len(t.encode()) for t in texts]])
    total, sizes = p.phrases(data, starts)
    for i, t in enumerate(texts):
        for j, k in enumerate(sorted(refs)):
            assert total[i, j] == brute_parse(folded(t), folded(refs[k].decode()))


@pytest.mark.parametrize("kept", [L.KEPT_STATES, 1])
def test_long_texts_are_parsed_as_one(monkeypatch, kept):
    """Texts around and far beyond a block, over one group of blocks and over many: random, periodic, and the reference itself."""
    monkeypatch.setattr(L, "KEPT_STATES", kept)
    rng = random.Random(8)
    chars = lambda n, of="abcde fghü": "".join(rng.choice(of) for _ in range(n))
    refs = {"x": (chars(3000) + "ab" * 700).encode(), "y": chars(2500, "abc de").encode(), "z": b"q"}
    sizes = [1, 255, 256, 257, 511, 512, 513, 5000, 100_000 if kept > 1 else 30_000]
    texts = [chars(n) for n in sizes] + [refs["x"].decode(), refs["x"].decode()[100:2900], "ab" * 1500, "a" * 1000, "q" * 600, "7" * 600] + [chars(n, "abc de") for n in sizes[:-1]]
    p = L.Parser(refs)
    data = L.np.frombuffer("".join(texts).encode(), L.np.uint8)
    total, _ = p.phrases(data, L.np.cumsum([0, *[len(t.encode()) for t in texts]]))
    for i, t in enumerate(texts):
        assert total[i].tolist() == [brute_parse(folded(t), folded(refs[k].decode())) for k in sorted(refs)], i
    assert total[len(sizes), 0] == 1


def test_predictions_are_the_least_entropies(small):
    refs = L.fit(small)
    assert all(0 < len(v) <= L.SAMPLE_BYTES + L.SAMPLE_DOCS for v in refs.values())
    whole = {(r.text or "").encode() for r in small.where(~L.held_out(F.col("doc_id"))).select("text").collect()}
    folded_refs = {k: folded(v.decode()) for k, v in sorted(refs.items())}
    assert all(any(v.startswith(t) for t in whole if t) for v in refs.values())
    for r in L.language_id(small, keep=["doc_id", "text"]).where(F.length("text") < 1500).collect():
        t = folded(r.text or "")
        if any(c.isalpha() for c in r.text or ""):
            cost = {k: brute_parse(t, v) * math.log2(len(v)) / len(t) for k, v in folded_refs.items()}
            best, second = sorted(cost.values())[:2]
            assert r.lang_pred == min(cost, key=lambda k: (cost[k], k)) and abs(r.score - (1 - best / second)) < 1e-9


def test_language_accuracy(small):
    got = {r.doc_id: r for r in L.language_id(small, keep=["doc_id", "lang"]).collect()}
    held = [r for i, r in got.items() if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 40 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edge(edge, edge_rows, empty):
    rows = L.language_id(edge, keep=["doc_id", "text", "score"]).collect()
    assert len(rows) == len(edge_rows)
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    kept = L.identified(edge)
    assert kept.columns == edge.columns and kept.count() == sum(any(c.isalpha() for c in t or "") for _, t, _ in edge_rows)
    assert L.language_id(empty).count() == 0 and L.identified(empty).count() == 0


def brute_shard(doc_id, n_shards: int) -> int:
    def draw(c, key):
        u = (int(hashlib.md5(f"{c.name}:{key}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        return -math.log(u) / c.weight

    own = "null" if doc_id is None else str(doc_id)
    for key in (own, f"{own}#1", f"{own}#2"):
        node: Node = topology(n_shards)
        while node.shard is None:
            node = min(node.children, key=lambda c: draw(c, key))
        if node.shard < n_shards:
            return node.shard
    return min((x for x in leaves(topology(n_shards)) if x.shard < n_shards), key=lambda x: draw(x, f"{own}#last")).shard


def test_shards_edge(edge, edge_rows, empty):
    rows = shards(edge, 8).collect()
    assert len(rows) == len(edge_rows)
    for r in rows:
        assert r.shard == brute_shard(r.doc_id, 8) and r.grown_shard == brute_shard(r.doc_id, 9)
    assert sorted((r.doc_id or 0, r["size"], r.text_crc32) for r in rows) == sorted((i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in edge_rows)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert shards(empty).count() == 0


def test_growth_moves_into_the_new_shard_only(spark):
    ids = spark.range(20_000).select("id", F.col("id").alias("doc_id"), F.lit("").alias("text"))
    rows = shards(ids, 8).collect()
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert moved and all(r.grown_shard == 8 for r in moved) and abs(len(moved) / len(rows) - 1 / 9) < 0.02
    assert all(2000 < sum(r.shard == s for r in rows) < 3000 for s in range(8))
    # At every count, from one shard on.
    several = ids.where("id < 4000").select("id", *[shard_of(F.col("id").cast("string"), n).alias(f"s{n}") for n in range(1, 14)]).collect()
    for n in range(1, 14):
        assert {r[f"s{n}"] for r in several} == set(range(n))
        assert min(sum(r[f"s{n}"] == k for r in several) for k in range(n)) > 0.8 * 4000 / n
        assert n == 13 or all(r[f"s{n}"] == r[f"s{n + 1}"] or r[f"s{n + 1}"] == n for r in several)
    assert all(r[f"s{n}"] == brute_shard(r.id, n) for r in several[:100] for n in range(1, 14))


URLS = [None, "", "no scheme/x", "http://", "HTTP://WWW.Example.ORG/es/1?x#y", "https://example.org/es", "https://a.b.example.org/en/17", "https://org/", "https://notexample.org/en/1", "ftp://x.com/fr/", "x://x.com/de/a://b", "x://com/de/", "x://exa\nmple.org/a", "x://example.org?/es/"]


def test_urls_edge(spark):
    from gleanspark.llm.queries import URL_RULES

    pages = spark.createDataFrame([(i if i else None, u, "?") for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, host string")
    rules = spark.createDataFrame([*URL_RULES, ("example.org", "/es/", "allow")], "host string, path string, verdict string")
    expected = []
    for i, u in enumerate([*URLS, *URLS]):
        host, path = "", ""
        if m := re.search(r"://([^/?#]*)([^?#]*)", u or ""):
            host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
        fit = [(len(h + p), h + p, v) for h, p, v in URL_RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        expected.append((i if i else None, host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "allow"))
    assert sorted(map(str, map(tuple, url_filter(pages, rules).collect()))) == sorted(map(str, expected))
    assert url_filter(pages.where("false"), rules).count() == 0
    assert {r.verdict for r in url_filter(pages, rules.where("false"), "block").collect()} == {"block"}


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_hash_prefixes_that_collide_are_told_apart(spark, monkeypatch, broadcast):
    """Whatever the prefixes, the full digests decide; here all rules share two prefixes."""
    from gleanspark.llm import url_filter as U

    monkeypatch.setattr(U, "BROADCAST_RULES", broadcast)
    rules = spark.createDataFrame([(f"h{k}.example", f"/p{k}/", "block" if k % 2 else "allow") for k in range(40)], "host string, path string, verdict string")
    pages = spark.createDataFrame([(k, f"http://a.h{k % 50}.example/p{k % 45}/x" + "y" * 3000 * (k % 3)) for k in range(300)], "page_id long, url string")
    expected = sorted(map(str, url_filter(pages, rules).collect()))
    monkeypatch.setattr(U, "hash_prefix", lambda digest: F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(2)))
    joined = url_filter(pages, rules)
    assert sorted(map(str, joined.collect())) == expected
    assert {r.rule for r in joined.collect()} - {None} == {f"h{k}.example/p{k}/" for k in range(40) if any(i % 50 == k and i % 45 == k for i in range(300))}
