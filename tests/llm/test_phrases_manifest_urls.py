import hashlib
import re
import zlib
from collections import Counter, defaultdict

import cases
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skywait.llm import collocations, merkle, url_filter

LOWER = str.maketrans(merkle.UPPER, merkle.LOWER)


# --- phrases ---


def plain_phrases(rows, least, longest, top):
    f, n = defaultdict(Counter), Counter()
    for text, named in rows:
        lang = "und" if named is None else named
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        grams = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in grams.items():
            cut = min((1000000 * a * a // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
            inside = any(
                len(h) > len(g) and 100 * b >= 50 * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in grams.items()
            )
            if not inside:
                kept.append((-cut[0], -a, " ".join(g).encode(), a, counts[g[: cut[1]]], counts[g[cut[1] :]]))
        out += [(lang, k, p.decode(), a, x, y, n[lang], -s) for k, (s, _, p, a, x, y) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBé \t.,\n\x0b\xa0", max_size=20)), max_size=6))
def test_words_and_pieces_of_texts(texts):
    words, follows = collocations.split_words(pa.array(["skipped", *texts], pa.string()).slice(1))
    want, after = [], []
    for t in texts:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (t or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            want += w
            after += [True] * (len(w) - 1) + [False] * bool(w)
    assert words.to_pylist() == want and follows.tolist() == after


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_phrases_against_all_counts(spark, longest):
    docs = cases.make(spark, extra=True, n=90).select("*").union(cases.make(spark, extra=True, n=20, seed=8)).withColumn("text", F.regexp_replace("text", "(sch|er|la)", "$1 "))
    rows = [(r.text, r.lang) for r in docs.collect()]
    got = collocations.collocations(docs.repartition(3), top=60, longest=longest, slice_bytes=5000)
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"), ("r", "bigint"), ("n", "bigint"), ("score", "bigint")]
    want = plain_phrases(rows, 10, longest, 60)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 100


def test_ties_overlaps_nulls_and_empty_tables_of_phrases(spark):
    rows = [("x x x x x x x x x x x", None), ("b a b a b a", "und"), ("b a, b a! B A\nb\ta b a", ""), (None, "en"), ("", "en"), ("ü z " * 12, ""), ("z ü. " * 12, "")] * 3
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = collocations.collocations(docs, least=3)
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(rows, 3, 3, 2000)
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs.where("lang = 'en'")).count() == 0


def test_rows_of_slices_stay_small_and_are_numbered_once(spark):
    text = " ".join(f"w{k} w{k}" for k in range(3000))
    docs = spark.createDataFrame([(text, "en"), (text, None), ("a b " * 500, "en")] * 2, "text string, lang string").repartition(2)
    cut = collocations.settle(collocations.sliced(docs, 20_000))
    held = collocations._named(cut, ["lang", "word"], 2)
    pairs = collocations.settle(collocations.paired(held, True))
    for rows in (cut, held, pairs):  # nothing but a slice's units grows with it: no row gathers its words or names
        assert not [c for c, kind in rows.dtypes if kind.startswith(("array", "map", "struct"))]
        each = rows.where("units is null")
        assert each.count() == each.select(F.col("slice") + F.col("spot")).distinct().count() > 6000
        assert rows.where("units is not null").count() == rows.select("slice").distinct().count()
    ids, words = held.select("id").where("id is not null").distinct().count(), cut.where("count is not null").groupBy("lang", "word").agg(F.sum("count").alias("f")).where("f >= 2").count()
    assert ids == words == held.where("f is not null").count()


def test_scores_are_exact_past_64_bits(spark):
    a, left, right = 98_765_432_101_234, 98_765_432_101_239, 99_999_999_999_998
    row = spark.createDataFrame([(a, left, right), (7, 7, 7), (1, 10**13, 10**14 - 1)], "a long, l long, r long").select(collocations.score("a", "l", "r").alias("s"))
    assert [r.s for r in row.collect()] == [1000000 * a * a // (left * right), 1000000, 0]


# --- manifest ---


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, lower=False):
    out = ""
    for c in merkle.FIELDS:
        v = row[c]
        if v is not None:
            v = str(v).translate(LOWER) if c == "text" and lower else str(v)
        out += "-" if v is None else f"{len(v.encode())}:{v}"
    return sha(out)


def plain_tree(nodes, fan):
    """Root, and each node's (before, after) siblings by level."""
    paths, at, now = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(now) > 1:
        for k, p in enumerate(at):
            run = now[p // fan * fan : p // fan * fan + fan]
            paths[k].append(("".join(run[: p % fan]), "".join(run[p % fan + 1 :])))
            at[k] = p // fan
        now = [sha(*now[i : i + fan]) for i in range(0, len(now), fan)]
    return now[0] if now else None, paths


def plain_manifest(rows, fan):
    trees = defaultdict(list)
    for r in rows:
        trees[r["source"]].append(r)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    inner = {}
    for s in names:
        trees[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        inner[s] = plain_tree([plain_leaf(r) for r in trees[s]], fan)
    root, above = plain_tree([inner[s][0] for s in names], fan)
    out = []
    for s, over in zip(names, above, strict=True):
        for r, own in zip(trees[s], inner[s][1], strict=True):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            path, node = [*own, *over], plain_leaf(r, tampered)
            for a, b in path:
                node = sha(a, node, b)
            out.append((r["doc_id"], plain_leaf(r), inner[s][0], root, sha(*[x for p in path for x in p]), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize(("fan", "levels", "sources"), [(16, 3, 3), (16, 1, 40), (2, 2, 7), (3, 1, 1), (2, 3, 20)])
def test_manifest_against_plain_trees(spark, fan, levels, sources):
    docs = cases.make(spark, extra=True, n=90).withColumn("source", F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 3 > 0, "é").otherwise(F.concat(F.lit("s"), F.col("doc_id") % sources)))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.initcap("text")).otherwise(F.col("text")))
    if sources == 1:
        docs = docs.withColumn("source", F.lit("only"))
    twice = docs.unionByName(docs.where("doc_id % 4 = 0 or doc_id is null"))
    got = merkle.manifest(twice.repartition(3), fan, levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = plain_manifest([r.asDict() for r in twice.collect()], fan)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert {x[-1] for x in want} == {True, False}


def test_small_and_empty_manifests(spark):
    docs = cases.make(spark, n=4)
    one = docs.where("doc_id = 1005")
    row = merkle.manifest(one).first()
    assert row.leaf == row.subroot == row.root == plain_leaf(one.first().asDict()) and row.proof_sha256 == sha()
    assert merkle.manifest(docs.limit(0)).count() == 0
    same = docs.where("doc_id = 3").select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
    same = same.unionByName(same).unionByName(same)
    assert sorted((tuple(r) for r in merkle.manifest(same, 2, 1).collect()), key=str) == plain_manifest([r.asDict() for r in same.collect()], 2)


# --- urls ---


def plain_url(url):
    if url is None or "://" not in url:
        return "", "", None
    after = url.split("://", 1)[1]
    raw = re.match("[^/?#]*", after)[0]
    rest = after[len(raw) :]
    host, path = raw.translate(LOWER), re.match("[^?#]*", rest)[0]
    query = rest[len(path) :].split("#")[0].removeprefix("?")
    site = re.sub(r"^www\.", "", re.sub(":(80|443)?$", "", host.rsplit("@", 1)[-1]))
    args = sorted(p for p in query.split("&") if p and not re.match(r"(utm_[^=]*|gclid|fbclid|ref)(=|$)", p))
    return host, path, site + path.rstrip("/") + "?" * bool(args) + "&".join(args) if site else None


def plain_verdict(url, listed, rules):
    host, path, page = plain_url(url)
    fits = [(len(h + p), h + p, act) for act, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, default=None)
    return host, path, rule and rule[1], rule[2] if rule else "block" if page in listed else "allow", page, page in listed


URLS = [
    None, "", "no scheme", "mailto:a@b", "http://", "https:///x", "http://Example.NET/en/1?utm_source=f#top", "http://a.b.example.net/en", "http://a.example.net/de/2", "http://notexample.net/en/3",
    "https://example.com/de/4", "http://x.EXAMPLE.com/De/4", "https://www.example.com/fr/5/", "http://example.com:80/fr/5?ref=x", "http://u:p@example.com/fr/5#a?b", "https://example.com/fr/5?b=2&a=1&utm_x=3",
    "http://example.com/fr/5?a=1&b=2", "http://org/fr/", "http://a.org/fr/x", "http://a.org/fr", "http://a.org?x=/fr/", "http://net", "http://net/", "ftp://É.com/ü?q=://z", "see http://a.com://b/c", "http://a.com/x\ny", "http://a.com/" + "long/" * 3000,
]


@pytest.mark.parametrize(("rules", "bits", "blocks"), [(url_filter.RULES, 16, 1 << 19), (url_filter.RULES, 1, 1), ((), 16, 2), ((("allow", "com", "/"),), 2, 3)])
def test_verdicts_against_a_plain_version(spark, rules, bits, blocks):
    urls = [*URLS, *URLS, *[f"http://h{k % 7}.example.com/p/{k}?utm_k={k}" for k in range(300)]]
    pages = spark.createDataFrame([(k if k % 9 else None, u, "x", 1) for k, u in enumerate(urls)], "page_id long, url string, canonical string, listed int").repartition(3)
    chosen = [None, "", "x", "https://example.com/fr/5", "http://a.com/" + "long/" * 3000, "http://net/", *[f"https://www.h{k % 7}.example.com/p/{k}/" for k in range(0, 300, 3)], *[f"http://else.com/{k}" for k in range(500)]] * 2
    listed = spark.createDataFrame([(u, "v") for u in chosen], "url string, verdict string")
    got = url_filter.judge(pages, listed, rules, bits, blocks)
    names = {plain_url(u)[2] for u in chosen} - {None}
    want = [(k if k % 9 else None, *plain_verdict(u, names, rules)) for k, u in enumerate(urls)]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert 100 < sum(w[-1] for w in want) < 150


def test_empty_lists_and_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://a.net/x")], "page_id long, url string")
    none = pages.limit(0)
    assert {r.page_id: r.verdict for r in url_filter.judge(pages, none.select("url")).collect()} == {1: "allow", 2: "block"}
    assert url_filter.judge(none, pages).count() == 0
    with pytest.raises(ValueError, match="same host"):
        url_filter.judge(pages, none, (("allow", "a", "/"), ("block", "a", "/")))


def test_the_filter_stops_nearly_all_that_is_not_listed(spark):
    listed = spark.range(2000).select(F.concat(F.lit("host.com/"), "id").alias("canonical"))
    blocks = 2000 * 16 // 512
    bloom = url_filter.bloom_blocks(listed, blocks)
    asked = spark.range(1000, 22000).select("id", F.concat(F.lit("host.com/"), "id").alias("u")).withColumn("block", url_filter._block(F.col("u"), blocks)).join(bloom, "block")
    passes = F.lit(True)
    for k, bit in enumerate(url_filter._bits(F.col("u"))):
        passes = passes & (F.col(f"w{k}").bitwiseAND(bit) != 0)
    got = {r.id for r in asked.where(passes).collect()}
    assert set(range(1000, 2000)) <= got and len(got) - 1000 < 0.01 * 20000


def test_pages_of_toxic_documents(spark):
    pages = spark.createDataFrame([("http://a.com/en/12/",), ("http://b.com/en/13.html?x=/12/",), ("http://c.com/12x",), (None,), ("http://d.com/en/12#t",)], "url string")
    labels = spark.createDataFrame([(12, 1), (12, 1), (13, 0), (None, 1)], "doc_id long, toxic int")
    assert sorted(r.url for r in url_filter.pages_of_toxic_documents(pages, labels).collect()) == ["http://a.com/en/12/", "http://d.com/en/12#t"]
