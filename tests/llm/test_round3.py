"""Collocations, page extraction and ranked search: against brute force, on odd rows and with small parts."""

import html
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import bitsliced_search, collocations, common, exact_dedup, language_id, mincut_pages, mixing, registry, toxicity
from tests.conftest import DATA
from tests.llm.conftest import ROWS


def fold(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def counted(rows):
    """{lang: Counter of phrases of up to three words} of (lang, text) rows."""
    found = {}
    for lang, text in rows:
        of = found.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", fold(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                of.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return found


def collocated(rows, least, top):
    out = []
    for lang, f in counted(rows).items():
        n, kept = sum(c for p, c in f.items() if len(p) == 1), []
        for p, a in f.items():
            if len(p) < 2 or a < least or (len(p) == 2 and any(len(q) == 3 and c >= least and p in (q[:2], q[1:]) and 100 * c >= 50 * a for q, c in f.items())):
                continue
            score, k = min(((1000000 * a * a) // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


MINED = [(lang, t) for _, t, lang, _ in ROWS] + [("en", "to be or not to be. To be\tor not, to be or\x0bnot a\x00b a\x00b a\x00b a\x00b!"), ("en", "to be or not to be " * 40), (None, "x" * 5000 + " y " + "x" * 5000 + " y")]


def test_collocations_by_brute_force(spark):
    df = spark.createDataFrame(MINED, "lang string, text string").repartition(3)
    got = sorted(map(tuple, collocations.collocations(df, min_count=2, top=40).collect()))
    assert got == collocated(MINED, 2, 40) and any(r[0] == "und" for r in got)


def test_collocations_odd(odd, none):
    rows = [(lang, t) for _, t, lang, _ in ROWS]
    assert sorted(map(tuple, collocations.collocations(odd, min_count=2).collect())) == collocated(rows, 2, 2000)
    assert collocations.collocations(none).count() == 0


@pytest.mark.parametrize("small", [{"shard_words": 300, "chunk": 7, "range_nodes": 20}, {"shard_words": 1000, "chunk": 50, "range_nodes": 10**9, "merge_nodes": 60}])
def test_ranges_that_begin_inside_a_frequent_word(spark, small):
    """Cuts fall within the subtrees of words and pairs; their counts must be whole in every range."""
    rows = [("en" if i % 3 else "fr", " ".join("the of w%d"[: 3 if (i * j) % 2 else 6] if j % 2 else f"w{i * j % 23}" for j in range(40))) for i in range(60)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    want = {(lang, " ".join(p), c, f[p[:1]] if len(p) > 1 else 0, f[p[:2]] if len(p) > 2 else 0) for lang, f in counted(rows).items() for p, c in f.items() if c >= 3}
    nodes = collocations.frequent_nodes(df, min_count=3, **small).collect()
    assert [(r["lang"], r["phrase"], r["f"], r["l1"], r["l2"]) for r in nodes if r["depth"]].__len__() == len(want)
    assert {(r["lang"], r["phrase"], r["f"], r["l1"], r["l2"]) for r in nodes if r["depth"]} == want
    n = Counter()
    for r in nodes:
        if not r["depth"]:
            n[r["lang"]] += r["f"]
    assert n == {lang: sum(c for p, c in f.items() if len(p) == 1) for lang, f in counted(rows).items()}


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 987_654_321_987, 1_234_567_890_123, 2_345_678_901_234
    got = spark.range(1).select(F.lit(a).alias("a"), F.lit(left).alias("l"), F.lit(right).alias("r")).select(collocations.score("a", "l", "r").alias("s")).first()["s"]
    assert got == 1_000_000 * a * a // (left * right)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(rows, items, k):
    bags = [(i, Counter(TERM.findall(fold(t)))) for i, t in rows]
    full = [(i, b) for i, b in bags if b]
    n_docs, total = len(full), sum(sum(b.values()) for _, b in full)
    df = Counter(t for _, b in full for t in b)
    out = []
    terms = {}
    for q, t in items:
        terms.setdefault(q, set()).update(TERM.findall(fold(t)))
    for q, of in terms.items():
        scores = []
        for i, b in full:
            m = 50 + (50 * sum(b.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m)) for t in of if t in b)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(q, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


QUERIES = [(1, "small test OF many words"), (2, None), (3, "--- ..."), (4, "straße日本語 missing id an"), (5, "delta " * 3000), (1, "hello"), (6, "the word a b license licensed under version"), (None, "gamma world")]


@pytest.mark.parametrize("segment", [1, 3, 1 << 15])
def test_search_by_brute_force(spark, odd, segment):
    items = spark.createDataFrame(QUERIES, "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))
    for k in (2, 50):
        got = [tuple(r) for r in bitsliced_search.search(odd, items, k, segment=segment).collect()]
        assert sorted(got, key=str) == ranked([(i, t) for i, t, *_ in ROWS], QUERIES, k)


def test_search_of_nothing(spark, odd, none):
    items = spark.createDataFrame(QUERIES, "item_id bigint, text string")
    assert bitsliced_search.search(none, items).count() == 0
    assert bitsliced_search.search(odd, items.limit(0)).count() == 0
    assert bitsliced_search.search(odd, items).schema.simpleString() == "struct<item_id:bigint,rank:int,doc_id:bigint,score:bigint>"


def test_search_in_blocks_of_queries(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j) % 37}" for j in range(1 + i % 19))) for i in range(300)]
    items = [(i, f"w{i} w{i + 1} W{2 * i}") for i in range(30)]
    want = ranked(rows, items, 7)
    docs, asked = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(bitsliced_search, "BLOCK_TERMS", 9)
    got = [tuple(r) for r in bitsliced_search.search(docs, asked, 7, segment=64).collect()]
    assert sorted(got, key=str) == want


def test_sums_and_best_of_slices():
    rng = np.random.default_rng(5)
    for _ in range(30):
        values = [rng.integers(0, 1 << int(rng.integers(1, 40)), 256) * (rng.random(256) < 0.4) for _ in range(int(rng.integers(1, 9)))]
        total = []
        for v in values:
            bits = np.frombuffer(bitsliced_search.sliced(v), np.uint64).reshape(-1, 4)
            if total:
                bitsliced_search.add_slices(total, bits)
            else:
                total = list(bits)
        want = sum(values)
        assert (bitsliced_search.values_at(total, np.arange(256)) == want).all()
        for k in (1, 5, 50, 256):
            order = sorted(np.flatnonzero(want > 0).tolist(), key=lambda i: (-want[i], i))[:k]
            assert bitsliced_search.best(total, k).tolist() == sorted(order)


def test_long_queries_do_not_overflow():
    n = np.array([10**8], np.int64)
    got = bitsliced_search.impacts(np.array([3]), n, np.array([20_000]), 10**10, 10**12)
    assert got.tolist() == [20_000 * ((3 * 10**9) // (3000 + 20 * (50 + (50 * 10**8 * 10**10) // 10**12)))]


PAGES = {
    # plain blocks of a page without landmarks: shape and surroundings decide
    '<html><body><div class="top"><a href=x>Home</a> <a href=y>News</a></div><div><div>A long headline about things that matter</div><div>First paragraph with many words that tell a story about something, and it ends here.</div>'
    "<div>Second paragraph with many words that tell a story about something, and it ends here too.</div><div>Short.</div><div>Third paragraph with many words that tell a story about something, and it ends here.</div></div>"
    "<div><a href=1>Terms</a> <a href=2>Privacy</a></div></body>": "A long headline about things that matter\nFirst paragraph with many words that tell a story about something, and it ends here.\n"
    "Second paragraph with many words that tell a story about something, and it ends here too.\nShort.\nThird paragraph with many words that tell a story about something, and it ends here.",
    # frames that call themselves sidebar or header hold the article; headers, asides, forms, footers, comments and notices do not
    '<head><title>x</title></head><body class="has-sidebar"><div class="page no-sidebar header-fixed"><header class="site-header"><a href=x>Logo</a><h2>Site name</h2></header><main><article class="post"><header class="entry-header"><h1>Title &amp; more</h1></header>'
    '<div class="entry-content"><p>One&nbsp;two <b>three</b>,\n <i>four</i>.<p>Five &lt;six&gt;<aside class="pull">quote</aside><ul><li>a<li>b</ul><form><label>Name</label><input></form><figure><img><figcaption>Cap</figcaption></figure></div>'
    '<div class="post-share">Share this</div><footer>Posted by x</footer></article><section id="comments"><article class="comment"><p>This is a nice reader comment, with many words in it.</p></article></section></main>'
    '<aside class="sidebar"><p>Side text of a good many words that looks like prose.</p></aside></div><div class="cookie-notice"><p>We use cookies to make this site work better for you.</p><button>OK</button></div><footer>&copy; 2024</footer></body>': "Title & more\nOne two three, four.\nFive <six>\na\nb\nCap",
    "<body><form id=aspnet><div class=menu><a>m</a></div><div id=main-content><h1>The title of the page</h1><p>Hello there, this is the text of it.</p></div></form></body>": "The title of the page\nHello there, this is the text of it.",
    '<body><article><h1>T</h1><p hidden>no<div style="display: none"><p>no</p></div><p>yes<script>if (a < b) document.write("<p>no</p>")</script> it<!-- no --> is</p><noscript><p>no</p></noscript><template><p>no</p></template><textarea><p>no</textarea></article>': "T\nyes it is",
    '<article><p>a < b and 3 <4 &amp c &am<p>x<a href="unclosed>y</p><p>tail': "a < b and 3 <4 & c &am\nxy\ntail",
    "<article><p>text here<br>and here<a hre": "text here and here",
    '<article><p>Text one is here.</p><div class="ad"><p>Sign up for our letter now, it is free of any charge.</p></div><p>Text two is here.</p></article><script>var t = "</p>";': "Text one is here.\nText two is here.",
    "<nav><a>x</a></nav>": "", "": "", "   ": "",
}


def test_pages(spark):
    rows = [(i, f"u{i}", h, "clash") for i, h in enumerate([*PAGES, None, *list(PAGES)[:1]])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string").withColumns({c: F.lit("clash") for c in ("n_chars", "__html", "key", "x", "y")})
    want = [*PAGES.values(), "", *list(PAGES.values())[:1]]
    got = sorted(map(tuple, mincut_pages.extract(df, mincut_pages.fit(df)).collect()))
    assert got == [(i, f"u{i}", t, len(t)) for i, t in enumerate(want)]
    assert mincut_pages.extract(df.limit(0), mincut_pages.fit(df.limit(0))).count() == 0
    assert (mincut_pages.fit(df.limit(0)) == mincut_pages.PRIOR).all()


def test_pages_of_the_table(spark):
    """The article's blocks, cut out of the source by pattern."""
    got = {r["page_id"]: r for r in registry.QUERIES["op12_mincut_pages"](spark, DATA).collect()}
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert len(got) == len(pages) > 40
    for page in pages:
        body = re.search(r"<article>(.*?)(?:</article>|$)", page["html"], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|ul|li)\b[^>]*>", body.replace("<br>", " "))]
        want = "\n".join(x for x in blocks if x)
        assert (got[page["page_id"]]["text"], got[page["page_id"]]["n_chars"], got[page["page_id"]]["url"]) == (want, len(want), page["url"])


def test_least_cut_by_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        n = rng.randint(1, 9)
        edges = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 9)) for _ in range(rng.randint(0, 16))]
        excess = [rng.randint(-12, 12) for _ in range(n)]

        def price(side, edges=edges, excess=excess):
            return sum(c for a, b, c in edges if side[a] != side[b]) + sum(abs(x) for s, x in zip(side, excess, strict=True) if s != (x > 0) and x)

        side = mincut_pages.maximum_flow(n, *(list(x) for x in (zip(*edges, strict=True) if edges else [[], [], []])), excess)
        assert price(side) == min(price([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))


def test_long_and_hostile_pages_take_time_in_proportion():
    def seconds(source):
        began = time.perf_counter()
        mincut_pages.main_text(source)
        return time.perf_counter() - began

    for part in ("<p>some words of text here, as usual.</p><div><a href=x>link</a></div>", "<div>", "<p>a</p><article>", '<a href="', "<!--", "</", "<script>", "&#", "<ul><li>x", "<textarea>x</textarea>İ"):
        small, large = part * 2000, part * 16_000
        seconds(small)
        assert seconds(large) < 40 * max(seconds(small), 0.02)


def test_a_sample_of_any_table_size_has_rows(spark):
    """The share is compared in 63 bits: at 1e12 rows a class about as many are chosen as are wanted."""
    keys = spark.range(200_000).select("id")
    for share in (0.5, 1e-3, 2e-5):
        n = keys.filter(common.chosen_by_hash(share, "id")).count()
        assert abs(n - share * 200_000) <= 6 * (share * 200_000) ** 0.5 + 1
    least = spark.range(1).select(F.lit(0.0).alias("s"))
    assert keys.filter(common.chosen_by_hash(1.0, "id")).count() == 200_000 and least.count() == 1
    # what a share of 3,000 in 1e12 rows would choose, seen on the hashes alone
    part = F.xxhash64("id").bitwiseAND(F.lit((1 << 63) - 1)).cast("double") / F.lit(2.0**63)
    smallest = keys.agg(F.min(part)).first()[0]
    assert keys.filter(common.chosen_by_hash(smallest, "id")).count() == 1 and smallest * 2**20 < 8


def test_every_language_is_learned_from(spark):
    rows = [(i, f"the words of row {i} are these", "en") for i in range(3000)] + [(5, "le même texte", "fr")] * 3000
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    languages, sample = language_id.sampled(df, 100)
    n = sample.groupby("lang").size().to_dict()
    assert languages == ["en", "fr"] and n["fr"] == 1 and 25 <= n["en"] <= 80


def test_wide_values_of_hot_keys_are_not_broadcast(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "wide").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"))
    found = common.materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("body", F.when(F.col("key") == "wide", F.repeat(F.lit("x"), 100_000)).otherwise(F.col("key"))), "test-wide")
    out = common.look_up(rows, found, "key", "n")
    got = {r["id"]: (r["key"], r["n"], r["size"]) for r in out.select("id", "key", "n", F.length("body").alias("size")).collect()}
    assert len(got) == 20_000 and all(v[2] == (100_000 if v[0] == "wide" else len(v[0])) and v[1] == (6667 if v[0] in ("hot", "wide") else 1) for v in got.values())
    spread = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count_if(F.col("key") == "wide").alias("n")).agg(F.max("n")).first()[0]
    assert spread < 6667 * 0.6


def test_columns_of_odd_types(spark):
    rows = [(i, "Same" if i % 2 else "same ", {"a": i}, (i, "x")) for i in range(6)] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string, m map<string,int>, s struct<`a b`:int,c:string>")
    kept = exact_dedup.keep_one(df)
    assert kept.schema == df.schema and sorted((r["doc_id"], r["m"]["a"]) for r in kept.collect()) == [(4, 4), (5, 5)]
    model = toxicity.fit(df, spark.createDataFrame([(0, 1), (1, 0)], "doc_id bigint, toxic int"), F.lit(True))
    assert toxicity.drop_toxic(df, model).schema.simpleString() == df.schema.simpleString()


def test_empty_texts_are_not_multiplied_by_the_mix(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, "a"), (3, "some words here", "b"), (4, " ", "b")], "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r["copies"] for r in mixing.curriculum(df).collect()}
    assert got[1] == got[2] == 1 and got[4] <= 1
