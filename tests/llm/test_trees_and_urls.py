"""Operators 11 to 13 against brute force, over nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marketlake.llm import fp_search, merkle, url_filter

RND = random.Random(11)


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


# Operator 11

HOSTS = ["a.example.org", "EXAMPLE.org", "www.example.com", "shop-deals.example.net", "org", "notorg", "xexample.org", "fr.example.com:80"]
URLS = [f"http://{h}/{lang}/{n}{tail}" for h in HOSTS for lang in ("en", "es", "fr", "de") for n, tail in ((1, ""), (27, ".html"), (150, "?a=1&b=2"), (9, "#x"))]
URLS += [None, "", "no scheme", "http://", "http://example.org", "x://example.com?/fr/", "http://com/fr/", "a://b.com/fr/://c", "http://example.com/DE/1", "http://\u00e9.com/fr/\u00e9\n?", "http://example.com/fr/" + "9" * 200_000]
URLS += ["http://www.example.com/fr/1"] * 40


def judged(url):
    """Host, path and rule by hand."""
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    rules = [("example.org", "/en/1"), ("example.org", "/es/"), ("com", "/fr/"), ("com", "/de/"), ("org", "/")]
    rule = next((h + p for h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), None)
    return host, path, rule, {"example.org/en/1": "block", "example.org/es/": "block", "com/de/": "block", "com/fr/": "allow", "org/": "allow"}.get(rule)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumns({c: F.lit(f"own {c}") for c in ("row", "label", "id", "query", "depth", "entropy", "cell", "_label", "bins")}).repartition(3)


def test_urls_are_judged_by_the_longest_rule(spark, pages):
    out = url_filter.judge(pages)
    assert set(pages.columns) < set(out.columns) and out.where("label != 'own label' OR depth != 'own depth' OR row != 'own row'").isEmpty()
    rows = out.collect()
    assert len(rows) == len(URLS)
    for r in rows:
        host, path, rule, verdict = judged(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["score"] > 0.5 else "allow")) and 0 <= r["score"] <= 1
    again = {r["page_id"]: (r["verdict"], r["score"]) for r in url_filter.judge(pages.repartition(5)).collect()}
    assert again == {r["page_id"]: (r["verdict"], r["score"]) for r in rows}
    assert url_filter.judge(pages.where("false")).isEmpty()
    unlabelled = url_filter.judge(pages.where("url LIKE 'no%'"))
    assert [(r["host"], r["rule"], r["verdict"]) for r in unlabelled.collect()] == [("", None, "allow")]


def test_url_filter_uses_no_python_on_executors(pages):
    plan = url_filter.judge(pages)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_url_entropy_and_features(spark):
    texts = [u for u in URLS if u and len(u) < 1000] + ["aaaa", "\U0001f600\U0001f600ab"]
    df = url_filter.lexical(url_filter.with_parts(spark.createDataFrame([(t,) for t in texts], "url string")))
    for r in df.collect():
        n = len(r["url"])
        assert r["entropy"] == pytest.approx(-sum(c / n * math.log2(c / n) for c in Counter(r["url"]).values()), abs=1e-9)
        assert r["digit_ratio"] == pytest.approx(sum(c in "0123456789" for c in r["url"]) / n)
        assert r["depth"] == r["path"].count("/")
        asked = r["query"].split("#")[0][1:] if r["query"].startswith("?") else ""
        assert (r["parameters"], r["fragment"]) == (len(asked.split("&")) if asked else 0, float("#" in r["query"]))


def test_url_trees_learn_from_labels(spark):
    """Held-out accuracy where the label follows lexical features, with a third of the rows one url."""
    rows = []
    for i in range(3000):
        bad = RND.random() < 0.5
        host = "-".join(RND.choice(["win", "cash", "big"]) for _ in range(3)) + ".example.com" if bad else RND.choice(["news", "blog"]) + ".example.com"
        url = f"http://{host}/{RND.randrange(10**9) if bad else 'about'}" + ("/x" * RND.randrange(3)) + ("?a=1&b=2&c=3" if bad and RND.random() < 0.7 else "")
        rows.append((i, url, None if i % 5 == 0 else int(bad), int(bad)))
    rows += [(9000 + i, "http://hot.example.com/page", 0, 0) for i in range(1500)]
    out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, known int, truth int"), rules=(), label=F.col("known"), sample=2000)
    held = out.where("known IS NULL")
    assert held.where("(verdict = 'block') = (truth = 1)").count() > 0.95 * held.count()


def test_suffix_statistics_count_all_rows(spark, pages):
    rows = url_filter.with_rule(url_filter.with_parts(pages.select(F.coalesce("url", F.lit("")).alias("url"))), url_filter.RULES).withColumn("label", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0))
    got = url_filter.suffix_statistics(rows).where(f"cell < {url_filter.BUCKETS}").agg(F.sum("n"), F.sum("known"), F.sum("blocked")).first()
    want = [judged(u)[3] for u in URLS]
    assert tuple(got) == (len(URLS), sum(v is not None for v in want), want.count("block"))


# Operator 12

DOCS = [(i, RND.choice(["web", None, "\u00e9"]), RND.choice(["en", "en", "en", "de", None, ""]), None if i % 11 == 0 else i, RND.choice(["", None, f"text {i}", "x" * 100_000, "\u4e2d"])) for i in range(90)]
DOCS += [(None, "s", "en", 1, "a"), (7, "s", "en", 1, "b"), (7, "s", "en", 1, "b"), (7, "s", "en", 1, "b"), (12345678901, "s", "lone", 3, "c"), (None, None, None, None, None)]


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_of(nodes):
    """All levels of a list of digests."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def climb(levels, at, x):
    """The top with another node at ``at``, and the siblings passed."""
    siblings = []
    for level in levels[:-1]:
        first = at - at % 2
        run = [x if i == at else v for i, v in enumerate(level) if first <= i < first + 2]
        siblings += [v for i, v in enumerate(level) if first <= i < first + 2 and i != at]
        x, at = sha("".join(run)), at // 2
    return x, siblings


def brute_manifest(docs):
    langs = sorted({d[2] for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {g: sorted((d for d in docs if d[2] == g), key=lambda d: (d[0] is not None, d[0] or 0, leaf_of(d))) for g in langs}
    trees = {g: tree_of([leaf_of(d) for d in rows]) for g, rows in groups.items()}
    forest = tree_of([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, (doc_id, source, lang, n_chars, text) in enumerate(groups[g]):
            leaf = leaf_of((doc_id, source, lang, n_chars, text))
            bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            x = leaf_of((doc_id, source, lang, n_chars + 1 if bad and n_chars is not None else n_chars, text))
            x, below = climb(trees[g], i, x)
            x, over = climb(forest, k, x)
            out.append((doc_id, leaf, trees[g][-1][0], forest[-1][0], sha("".join(below + over)), x, x == forest[-1][0]))
    return out


@pytest.mark.parametrize("levels", [1, 2, 12])
def test_manifest(spark, tmp_path, monkeypatch, levels):
    """With chunks of two, four and many leaves: several rounds up and down."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "CHUNK", 1 << levels)
    docs = spark.createDataFrame(DOCS, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit(1) for c in ("tree", "pos", "size", "digest", "chunk", "key", "row", "part", "path", "name")})
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op12_merkle_manifest(spark, str(tmp_path))
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(str, brute_manifest(DOCS)))
    if levels == 12:
        docs.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
        assert merkle.op12_merkle_manifest(spark, f"{tmp_path}/none").isEmpty()


def test_parent_resumes_the_state_of_each_slot():
    for children in (["a"], ["a", "b"], ["a", "b", "c", "d"]):
        parent = merkle.Parent([sha(c) for c in children])
        assert parent.digest == sha("".join(map(sha, children)))
        for slot in range(len(children)):
            assert parent.fold(slot, "x" * 64) == sha("".join("x" * 64 if i == slot else sha(c) for i, c in enumerate(children)))


# Operator 13

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return SPLIT.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k=10):
    held = [(i, Counter(terms_of(t)), len(terms_of(t))) for i, t in docs]
    held = [d for d in held if d[2]]
    count, length = len(held), sum(d[2] for d in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for item, terms in asked.items():
        found = []
        for doc, tf, n in held:
            m = 100 - 90 + (90 * n * count) // length
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms if tf[t])
            if score > 0:
                found.append((-score, doc is None, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


WORDS = [f"w{i}" for i in range(60)] + ["caf\u00e9", "\u4e2d\u6587", "\u00c9t\u00e9", "9"]
SEARCHED = [(i, " ".join(RND.choices(WORDS, [1 / (j + 1) for j in range(len(WORDS))], k=RND.randrange(1, 60)))) for i in range(400)]
SEARCHED += [(500 + i, "W1 w2-w40.w41") for i in range(120)] + [(None, "w1 w2 w40 w41"), (None, ""), (700, None), (701, " \t\x00--"), (702, "w3 \x00w4\x7fw5\u0085w6 " * 20_000), (3, "w2 w50"), (3, "w2 w50")]
ITEMS = [(i, " ".join(RND.choices(WORDS, k=RND.randrange(1, 12)))) for i in range(25)] + [(30, None), (31, ""), (32, "absent words"), (33, "w1 w2 w40 w41"), (None, "w5 W5 caf\u00e9"), (34, "w1"), (34, "w50 w51")]


@pytest.mark.parametrize(("tree", "leaf", "block"), [(fp_search.TREE, fp_search.LEAF, fp_search.BLOCK), (400, 2, 40)])
def test_ranked_search(spark, monkeypatch, tree, leaf, block):
    monkeypatch.setattr(fp_search, "TREE", tree)
    monkeypatch.setattr(fp_search, "LEAF", leaf)
    extra = {c: F.lit("own") for c in ("id", "terms", "tfs", "n", "item", "score", "rank", "no", "block", "place", "total", "before", "_part")}
    docs = spark.createDataFrame(SEARCHED, "doc_id long, text string").withColumns(extra).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns(extra)
    got = [tuple(r) for r in fp_search.search(docs, items, block=block).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_search(SEARCHED, ITEMS)))
    assert fp_search.search(docs.where("false"), items, block=block).isEmpty() and fp_search.search(docs, items.where("false"), block=block).isEmpty()


def test_tree_nodes_cover_documents_and_bound_their_scores():
    import numpy as np

    rnd = np.random.default_rng(5)
    sets = [np.sort(rnd.choice(40, size=rnd.integers(1, 12), replace=False)) for _ in range(300)] + [np.array([1, 2, 3])] * 50
    sizes = np.array([len(s) for s in sets])
    m = rnd.integers(10, 200, len(sets))
    tfs = rnd.integers(1, 9, int(sizes.sum()))
    tree = fp_search.Tree(np.arange(len(sets)), m, sizes, np.concatenate(sets), tfs)
    leaves = [v for v, leaf in enumerate(tree.leaf) if leaf]
    assert sorted(i for v in leaves for i in range(tree.lo[v], tree.hi[v])) == list(range(len(sets)))
    assert len(tree.lo) > 20
    for v in range(len(tree.lo)):
        for t in range(40):
            a, b = tree.by_term[t], tree.by_term[t + 1]
            bound = {int(n): int(p) for n, p in zip(tree.bound_node[a:b], tree.bound_part[a:b])}.get(v, 0)
            s, e = int(tree.starts[tree.lo[v]]), int(tree.ends[tree.hi[v] - 1])
            held = tree.parts[s:e][tree.terms[s:e] == t]
            assert bound >= (held.max() if len(held) else 0) and (len(held) > 0) == (bound > 0)
