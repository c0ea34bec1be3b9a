"""Corpus operators against brute force, the library they must equal, SQL, and odd inputs."""

import hashlib
import math
import os
import random
import textwrap
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lumispan.llm import chat, components, exact_dedup, langid, licenses, minhash, mixing, pieces, quality, queries, sharding, urlfilter

SF = "/root/testdata/sf0.001"
HAVE = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SPACE = b" \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n", "en", "a", 3),
    (4, "one two", "en", "a", 7),
    (5, "one\ttwo ", "en", None, 8),
    (6, "Ünïcode 😀 ▁ text here now", "de", "b", 1),
    (7, "word " * 30_000, "en", "b", 150_000),
    (8, "one two", "en", "a", 7),
    (8, "one two", "en", "a", 7),
    (None, "one two", "en", "a", 7),
    (9, "x" * 200_000, "fr", "c", 200_000),
    (10, "\0 nul \x1f\x85 marks", "fr", "c", 1),
]


def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def texts_of(name="documents"):
    return duckdb.sql(f"select * from '{SF}/{name}.parquet'").df()


def plain(frame):
    value = lambda v: None if v is None or (not isinstance(v, (list, np.ndarray)) and pd.isna(v)) else round(float(v), 9) if isinstance(v, float) else int(v) if hasattr(v, "__index__") and not isinstance(v, bool) else str(v)
    return sorted(repr([value(v) for v in r]) for r in frame[sorted(frame.columns)].itertuples(index=False))


@HAVE
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_registered():
    assert {"pipeline", *queries.queries()} <= set(__spark_entry__.queries())


# -- components


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1090)] + [(2000, 2000 + i) for i in range(1, 80)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


# -- 1 language identification


@HAVE
def test_language_accuracy(spark):
    got = queries.op1_language_id(spark, SF).toPandas().merge(texts_of()[["doc_id", "lang", "n_chars"]], on="doc_id")
    assert len(got) == len(texts_of()) and got["score"].between(0, 1).all()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = got[got["held_out"] & (got["n_chars"] > 40)]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.9


def test_language_scores_whole_texts(spark):
    rng = random.Random(1)
    make = lambda words: " ".join(rng.choice(words) for _ in range(60))
    en, de = ["the", "and", "thing", "house"], ["der", "und", "schön", "haus"]
    rows = [(i, make(en), "en", "s", 1) for i in range(20)] + [(100 + i, make(de), "de", "s", 1) for i in range(20)] + [(900, make(en), None, "s", 1)]
    model = langid.train(spark.createDataFrame(rows, DOCS), docs_per_language=1000)
    assert model.languages == ("de", "en")
    # the long text is English only beyond its first slices
    long = "der und " * 70_000 + make(en) + " the and thing house" * 60_000
    labels, score = langid.score_texts(model, [make(en), make(de), None, "", "12 !? 34", long, "THE AND THING"])
    assert labels == ["en", "de", "und", "und", "und", "en", "en"] and score[2] == 0 and score[0] > 0.9
    # slices of a long text add up to the text
    cut, langid.SEGMENT = langid.SEGMENT, 50
    try:
        sliced = langid.score_texts(model, [rows[0][1], rows[25][1], "a" * 49 + "bcdef"])
    finally:
        langid.SEGMENT = cut
    whole = langid.score_texts(model, [rows[0][1], rows[25][1], "a" * 49 + "bcdef"])
    assert sliced[0] == whole[0] and np.allclose(sliced[1], whole[1])
    out = langid.predict(odd(spark).withColumn("score", F.lit("old")), model).toPandas()
    assert len(out) == len(ODD) and out["score"].dtype == float
    empty = langid.train(spark.createDataFrame([], DOCS))
    assert set(langid.predict(odd(spark), empty).toPandas()["lang_pred"]) == {"und"}
    assert langid.predict(spark.createDataFrame([], DOCS), model).count() == 0
    with pytest.raises(ValueError):
        langid.train(spark.createDataFrame(rows, DOCS), max_languages=1)


def test_language_against_brute_force(spark):
    # posteriors by plain loops: counts of hashed windows, add-one-half smoothing, priors by all labelled rows
    rng = random.Random(13)
    vocab = {"en": "the and of Stone, water's?", "de": "der schöne und Straße Wasser", "fr": "l'eau très bon à été"}
    make = lambda lang: " ".join(rng.choice(vocab[lang].split()) for _ in range(rng.randrange(3, 30)))
    rows = [(i, make(lang), lang, "s", 1) for i, lang in enumerate(rng.choices(["en", "de", "fr"], [3, 2, 1], k=90))]
    model = langid.train(spark.createDataFrame(rows, DOCS), docs_per_language=10**6, bits=12)

    def windows(text):
        text = "".join(c if c.isalpha() else " " for c in text.lower())
        for k in (1, 2, 3):
            for at in range(len(text) - k + 1):
                gram = text[at : at + k]
                if any(c.isalpha() for c in gram):
                    h = 0
                    for c, m in zip(gram, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
                        h = (h + ord(c) * m) & 0xFFFFFFFF
                        h ^= h >> 15
                        h = h * 0x2C1B3C6D & 0xFFFFFFFF
                    yield h >> 20

    counts = {lang: Counter(w for _, t, x, *_ in rows if x == lang for w in windows(t)) for lang in vocab}
    total = {lang: sum(c.values()) + 0.5 * 4096 for lang, c in counts.items()}
    prior = Counter(r[2] for r in rows)
    texts = [make("en") + " " + make("de") for _ in range(40)] + ["x", "é", "UND THE", "12 a 34"]
    labels, scores = langid.score_texts(model, texts)
    for t, label, score in zip(texts, labels, scores):
        logs = {lang: math.log(prior[lang] / 90) + sum(math.log((counts[lang][w] + 0.5) / total[lang]) for w in windows(t)) for lang in sorted(vocab)}
        best = max(logs, key=logs.get)
        assert label == best and abs(score - 1 / sum(math.exp(v - logs[best]) for v in logs.values())) < 1e-3


# -- 2 exact dedup


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").encode().translate(None, SPACE)].append((-len(t or ""), i is None, i or 0, i))
    keep = {k: min(v)[3] for k, v in groups.items()}
    return sorted((i is None, i or 0, keep[k], len(groups[k]), i == keep[k], hashlib.sha256(k).hexdigest()) for i, t in rows for k in [(t or "").encode().translate(None, SPACE)])


@pytest.mark.parametrize("limit", [64 << 20, 3000])
def test_exact_groups(spark, limit):
    rng = random.Random(5)
    rows = [(r[0], r[1]) for r in ODD] + [(100 + i, rng.choice(["ab", "a b", "a  b c", "abc" * 400, "abc" * 400 + " d"]) + rng.choice(["", " ", "\n", str(i % 7)])) for i in range(300)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), limit=limit).collect()
    assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got) == exact_brute(rows)


def test_trie_spills_by_subtree():
    rng = random.Random(9)
    keys = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 40))) for _ in range(3000)] + [b"", b"zz" * 5000]
    trie = exact_dedup.PatriciaTrie(limit=20_000)
    for i, k in enumerate(keys):
        trie.insert(k, (len(k) % 3, i), 1, b"")
    want = {}
    for i, k in enumerate(keys):
        o = (len(k) % 3, i)
        want[k] = (exact_dedup.better(want[k][0], o), want[k][1] + 1) if k in want else (o, 1)
    items = list(trie.items())
    assert len(items) == len(want) and {k: (o, n) for k, o, n, _ in items} == want


def test_exact_dedup_keeps_columns(spark):
    docs = odd(spark).withColumn("keep_id", F.lit("mine"))
    out = exact_dedup.dedup(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == [3, 5, 6, 7, 9, 10]  # a null id loses, as in the groups
    # a repeated id with two texts: only the copy goes; names with dots and backticks, and those of outputs, stay
    rows = [(1, "a", 7), (1, "b c", 8), (2, "b  c", 9), (None, "z", 1), (None, "z", 2)]
    odd_names = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumnRenamed("n", "x.y`z").withColumn("_gone", F.lit(1))
    assert sorted(tuple(r)[1:3] for r in exact_dedup.dedup(odd_names).collect()) == [("a", 7), ("b  c", 9), ("z", 1), ("z", 2)]
    assert exact_dedup.exact_groups(spark.createDataFrame([], DOCS)).count() == 0


# -- 3 url filter


def test_url_rules_and_aliases(spark):
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("allow", "good.com/a"), ("block", "bad.com/"), ("block", "net.io/x")]
    link = '<link href="/c" rel="canonical">'
    rows = [
        (1, "http://X.Org/p?q#f", None), (2, "https://m.example.ORG/es/1", ""), (3, "http://example.org", ""), (4, None, None), (5, "no-scheme/es/", ""), (6, "http://org/", ""), (7, "http://notorg/", ""),
        (10, "http://a.test/1", '<LINK rel=canonical href="http://bad.com/z">'), (11, "HTTP://A.test:80/1#x", ""), (12, "http://b.test/", '<meta http-equiv="refresh" content="0; url=http://a.test/1">'),
        (13, "http://bad.com/z", ""), (20, "http://c.test/", '<link rel="canonical" href="http://good.com/a/1">'), (21, "http://good.com/a/1", ""), (22, "http://net.io/x/9", '<link rel="canonical" href="http://c.test">'),
        (30, "http://d.test/b", link), (31, "http://d.test/c", ""), (32, "http://e.test/1", ""), (33, "http://bad.com:80/", ""), (13, "http://bad.com/z", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit(1))
    redirects = spark.createDataFrame([("http://e.test/1", "http://net.io/x/1")], "a string, b string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, rules, redirects=redirects).collect()}
    assert got[1] == ("x.org", "/p", "org/", "allow") and got[2] == ("m.example.org", "/es/1", "example.org/es/", "block")
    assert got[3] == ("example.org", "", None, "allow") and got[4] == got[5] == ("", "", None, "allow") and got[6][2] == "org/" and got[7][2] is None
    assert [got[i][3] for i in (10, 11, 12, 13)] == ["block"] * 4  # by canonical link, spelling and refresh
    assert [got[i][3] for i in (20, 21, 22)] == ["allow", "allow", "block"]  # allow wins among aliases, a page's own rule stays
    assert got[30][3] == got[31][3] == "allow" and got[32][3] == "block" and got[33][2] is None
    assert urlfilter.judge(pages.limit(0), rules).count() == 0


def url_brute(rows, rules):
    """Verdicts by the standard library's parser and url functions, and a search over the alias graph."""
    from html.parser import HTMLParser
    from urllib.parse import urljoin, urlsplit

    class Links(HTMLParser):
        def __init__(self):
            super().__init__()
            self.found = []

        def handle_starttag(self, tag, attrs):
            a = {}
            for k, v in attrs:
                a.setdefault(k, v or "")
            if tag == "link" and "canonical" in a.get("rel", "").lower().split():
                self.found.append(a.get("href", "").strip())
            if tag == "meta" and a.get("http-equiv", "").strip().lower() == "refresh" and ";" in a.get("content", ""):
                rest = a["content"].split(";", 1)[1].strip()
                self.found.append(rest[4:].strip(" '\"") if rest.lower().startswith("url=") else rest)

    def node(u):
        p = urlsplit(u)
        host = p.netloc.lower().removesuffix({"http": ":80", "https": ":443"}.get(p.scheme, "none"))
        return p.scheme, host, p.path or "/", p.query

    def rule(u):
        p = urlsplit(u)
        host = p.netloc.lower()
        fit = [(len(r), a) for a, r in rules for name, _, rest in [r.partition("/")] if (host == name or host.endswith("." + name)) and p.path.startswith("/" + rest)]
        return max(fit)[1] if fit else None

    graph, actions = defaultdict(set), defaultdict(set)
    for _, u, html in rows:
        parser = Links()
        parser.feed(html or "")
        if rule(u):
            actions[node(u)].add(rule(u))
        for t in parser.found:
            if t and not t.startswith("#") and "://" in (v := urljoin(u, t)):
                graph[node(u)].add(node(v))
                graph[node(v)].add(node(u))
                if rule(v):
                    actions[node(v)].add(rule(v))
    out = {}
    for i, u, _ in rows:
        seen, todo = {node(u)}, [node(u)]
        while todo:
            for n in graph[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        met = set().union(*(actions[n] for n in seen))
        out[i] = rule(u) or ("allow" if "allow" in met or not met else "block")
    return out


def test_url_edges_of_all_forms(spark):
    rules = [("block", "bad.com/"), ("allow", "bad.com/good/"), ("block", "other.net/x"), ("allow", "fine.org/")]
    rng = random.Random(12)
    forms = [
        '<link rel="canonical" href="{}">', "<LINK HREF='{}' REL='nofollow Canonical' />", "<link rel=canonical href={}>", '<meta content="0; url={}" http-equiv="refresh">', '<META HTTP-EQUIV=Refresh CONTENT="5;URL={}">',
        "<meta http-equiv='refresh' content='0; {}'>", '<!-- <link rel="canonical" href="{}"> -->', "<script>'<link rel=\"canonical\" href=\"{}\">'</script>", '<link rel="alternate" href="{}">', '<link data-href="{}" rel="canonical">',
    ]
    ends = ["http://bad.com/a", "https://bad.com/good/b", "//other.net/x/1", "/c/d", "../up", "./e?q=1&amp;r=2", "f", "?z=3", "#top", "http://FINE.org:80/p", "mailto:x@bad.com", "g/../../h", "//a5.test/c/d", "http://a7.test"]
    rows = []
    for i in range(220):
        html = "<html><head>" + "".join(rng.choice(forms).format(rng.choice(ends)) for _ in range(rng.choice([0, 1, 1, 2]))) + "</head><p>text</p>"
        rows.append((i, f"http{rng.choice(['', 's'])}://{rng.choice(['', 'A', 'a', 'www.a'])}{rng.randrange(40)}.test{rng.choice(['', '/', '/c/d', '/c/e?q=1&r=2', '/c/f#x', '/h', '/up'])}", html))
    rows += [(900, "http://a.test/1", ""), (901, "http://a.test/2", None), (902, "http://b.test/", '<meta content="0; url=http://bad.com/z" http-equiv="refresh">'), (903, "http://c.test/x/y?k=1", '<link rel="canonical" href="?x=1">'), (904, "http://c.test/x/y?x=1", '<link rel=canonical href="../../q"><link rel="canonical" href="http://bad.com/1">')]
    rows += [(905, "http://long.test/", "<link " * 50_000 + "<p>" * 50_000 + '<link rel="canonical" href="http://bad.com/">' + "<!-- canonical " * 20_000)]
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    want = url_brute([r for r in rows if r[0] != 905], rules) | {905: "block"}
    assert {i: (got[i], want[i], rows[i][1:] if i < 220 else "") for i in want if got[i] != want[i]} == {}
    assert 10 < sum(v == "block" for v in want.values()) < 200


def test_url_query_with_edges_matches_sql(spark, tmp_path):
    rows = [(1, "http://x.com/1", '<link rel="canonical" href="http://a.com/de/5">'), (2, "http://x.com/2", '<link href="1" rel=canonical>'), (3, "http://y.net/", '<meta content="0; url=//x.com/2?a=1&amp;b=2" http-equiv=refresh>'), (4, "http://x.com/2?a=1&b=2", '<link rel="canonical" href="/2">'), (5, "http://x.net:80", '<link rel=canonical href="http://z.org/q"><link rel="canonical" href="http://q.com/de/">'), (6, "http://x.net/", None), (7, None, "<link rel=canonical href=/x>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got, want = queries.op3_url_filter(spark, str(tmp_path)).toPandas(), con.sql(queries.oracle_sql()["op3_url_filter"]).df()
    assert plain(got) == plain(want)
    assert dict(zip(got["page_id"], got["verdict"])) == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow"}


# -- 4 quality rules


def measure_brute(text):
    words = text.encode().split()
    at = set()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    for i, w in enumerate(windows):
        if times[w] > 1:
            at |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(at)


@HAVE
def test_quality_counts(spark):
    docs = texts_of()
    got = queries.op4_quality_rules(spark, SF).toPandas().set_index("doc_id")
    for i, t in zip(docs["doc_id"], docs["text"]):
        r = got.loc[i]
        want = measure_brute(t)
        assert tuple(r[list(quality.COUNTS)]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])


def test_binomial_bound():
    assert abs(quality.binomial_tail(0, 10, 0.1) - 0.9**10) < 1e-12 and quality.binomial_tail(10, 10, 0.1) == 1
    assert abs(quality.binomial_tail(2, 10, 0.5) - 56 / 1024) < 1e-12
    none = [0] * 65
    spread = lambda **at: [at.get(f"b{i}", 0) for i in range(65)]
    assert quality.choose_bin(none, none, none, 0.01, 0.01) is None
    assert quality.choose_bin(spread(b0=500), spread(b40=50), spread(b0=2000), 0.01, 0.01) == 40
    assert quality.choose_bin(spread(b0=500), spread(b40=50), spread(b0=100), 0.01, 0.01) is None  # too few to certify
    assert quality.choose_bin(spread(b0=500), spread(b40=50, b60=50), spread(b0=2000, b45=300), 0.01, 0.01) == 46  # certified only above the good rows


def test_quality_thresholds(spark):
    rng = random.Random(2)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows, labels = [], []
    for i in range(3000):
        bad = i % 5 == 0
        rows.append((i, words(60) + (" #####" * 12 if bad else ""), "en" if i < 2900 else None, "s", 1))
        labels.append((i, 0 if bad else 1, 0))
    docs = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("old"))
    marks = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    measured = quality.features(docs)
    cutoffs = quality.fit(measured, marks, alpha=0.1)
    out = quality.judge(measured, cutoffs).toPandas()
    clean = out["doc_id"] % 5 != 0
    assert out[clean]["kept"].mean() > 0.95 and not out[~clean & (out["doc_id"] < 2900)]["kept"].any()
    assert out[out["doc_id"] >= 2900]["kept"].all()  # a stratum with too few labels rejects nothing
    few = quality.judge(quality.features(odd(spark)), cutoffs).toPandas()
    assert len(few) == len(ODD) and few["base_failed"].all()
    assert quality.judge(measured, quality.fit(measured, marks.limit(0))).filter("kept").count() == 3000
    assert quality.judge(quality.features(spark.createDataFrame([], DOCS)), cutoffs).count() == 0


def test_quality_certifies_with_production_parameters(spark):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows, labels = [], []
    for lang, good, bad in (("en", 1900, 160), ("de", 460, 50), ("es", 300, 30)):
        for k in range(good + bad):
            spoilt = k >= good
            rows.append((len(rows), words(60) + (rng.choice([" #####" * 12, "\nsame line here" * 20]) if spoilt else ""), lang, "s", 1))
            labels.append((rows[-1][0], 0 if spoilt else 1))
    measured = quality.features(spark.createDataFrame(rows, DOCS))
    cutoffs = quality.fit(measured, spark.createDataFrame(labels, "doc_id long, quality int"))
    rules = {r["stratum"]: r[1:] for r in cutoffs.collect()}
    assert rules["de"] == rules["es"] and all(any(b is not None for b in r) for r in rules.values())  # small strata are pooled
    out = quality.judge(measured, cutoffs).toPandas().merge(pd.DataFrame(labels, columns=["doc_id", "quality"]), on="doc_id")
    passed = out[~out["base_failed"]]
    for _, part in passed.groupby("lang"):
        assert part[part["quality"] == 1]["kept"].mean() >= 0.98 and part[part["quality"] == 0]["kept"].mean() < 0.1


def kept_brute(docs, labels, alpha=0.02, delta=0.05):
    """``kept`` of every document by plain loops over the rule of the docstring; halves are taken from ``hold``."""
    measured = {}
    for i, t, lang, hold in docs:
        m = quality.measure((t or "").encode())
        measured[i] = (m[0] < 50 or 100 * m[4] > 50 * m[0], lang, hold, [min(64, math.ceil(x * 64)) for x in m[5:]])
    rows = [(*measured[i][1:], q > 0) for i, q in labels.items() if i in measured and not measured[i][0]]
    good_hold = Counter({lang: 0 for lang, *_ in rows}) + Counter(lang for lang, hold, _, good in rows if hold and good)
    strata = {lang for lang, *_ in rows}
    tail = lambda k, n: sum(math.comb(n, j) * alpha**j * (1 - alpha) ** (n - j) for j in range(k + 1))
    small = {x for x in strata if tail(1, good_hold[x]) > delta / len(strata)}
    groups = [{x} for x in strata - small] + ([small] if len(small) > 1 else [])
    level = delta / (len(strata - small) + 1 if len(small) > 1 else len(strata))
    rule = {}
    for group in groups:
        tune = [(b, good) for lang, hold, b, good in rows if lang in group and not hold]
        held = [b for lang, hold, b, good in rows if lang in group and hold and good]
        n_good, n_bad = sum(g for _, g in tune), sum(not g for _, g in tune)
        cut = []
        for k in range(5):
            gain = [(sum(b[k] >= c and not g for b, g in tune) / max(1, n_bad) - sum(b[k] >= c and g for b, g in tune) / max(1e-9, alpha * n_good), c) for c in range(1, 65)]
            best = max(gain)
            cut.append(best[1] if n_good and n_bad and best[0] > alpha else None)
        joint = lambda b, cut=cut: max([0, *(v - c + 1 for v, c in zip(b, cut) if c is not None)])
        gain = [(sum(joint(b) >= c and not g for b, g in tune) / max(1, n_bad) - sum(joint(b) >= c and g for b, g in tune) / max(1, n_good), c) for c in range(1, 65)]
        want, certified = max(gain)[1] if n_good and n_bad and max(gain)[0] > 0 else 65, None
        for c in range(64, want - 1, -1):
            wrong = sum(joint(b) >= c for b in held)
            if not held or wrong > alpha * len(held) or tail(wrong, len(held)) > level:
                break
            certified = c
        for x in group:
            rule[x] = lambda b, joint=joint, certified=certified: certified is not None and joint(b) >= certified
    return {i: not base and not (lang in rule and rule[lang](bins)) for i, (base, lang, _, bins) in measured.items()}, groups


def test_quality_kept_against_brute_force(spark):
    rng = random.Random(31)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    spoil = [lambda: " #####" * rng.randrange(1, 30), lambda: "\nthe same line of text here" * rng.randrange(2, 12), lambda: " | " * rng.randrange(3, 40), lambda: " " + words(rng.randrange(10, 60)).upper()]
    rows, labels = [], {}
    for lang, n in (("en", 2600), ("de", 700), ("fr", 300), ("es", 250), (None, 30)):
        for _ in range(n):
            bad = rng.random() < 0.25
            text = words(rng.randrange(40, 70)) + (rng.choice(spoil)() if bad or rng.random() < 0.02 else "")
            if rng.random() < 0.9:
                labels[len(rows)] = 0 if bad and rng.random() < 0.95 else 1
            rows.append((len(rows), text, lang, "s", 1))
    docs = spark.createDataFrame(rows, DOCS)
    hold = {r["doc_id"]: r["h"] for r in docs.select("doc_id", (F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(2)) == 1).alias("h")).collect()}
    want, groups = kept_brute([(i, t, lang, hold[i]) for i, t, lang, *_ in rows], labels)
    measured = quality.features(docs.withColumn("_measured", F.lit(1)).withColumn("stratum", F.lit("x")))
    cutoffs = quality.fit(measured, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"))
    got = {r["doc_id"]: r["kept"] for r in quality.judge(measured, cutoffs).collect()}
    assert {i for i in want if got[i] != want[i]} == set()
    passed = {r["doc_id"] for r in quality.judge(measured, cutoffs).filter("not base_failed").collect()}
    assert sum(not want[i] for i in passed) > 100 and len(groups) == 2  # en and a pool


# -- 5 sharding


@pytest.mark.parametrize("partitions", [1, 7])
def test_shards(spark, partitions):
    rng = random.Random(4)
    rows = [(r[0], r[1]) for r in ODD] + [(rng.randrange(1000), "é" * rng.randrange(200)) for _ in range(2000)] + [(77, "same")] * 400
    got = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string"), 16, partitions=partitions).toPandas()
    assert Counter((None if pd.isna(i) else int(i), int(s), int(c)) for i, s, c in zip(got["doc_id"], got["size"], got["text_crc32"])) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    line = sorted((-1 if i is None else i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows)
    total, at, want = sum(x[2] for x in line), 0, []
    for i, c, s in line:
        want.append((at * 16 // total, i, c, s))
        at += s
    got["doc_id"] = got["doc_id"].fillna(-1)
    assert sorted(zip(got["shard"], got["doc_id"], got["text_crc32"], got["size"])) == sorted(want)
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
        assert part.sort_values("slot")["doc_id"].is_monotonic_increasing
    assert sharding.balanced_shards(spark.createDataFrame([], DOCS)).count() == 0


# -- 6 chat


def test_chat(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", x) for c, turns in {1: "ab", 2: "abc", 3: "abc", 4: "abd", 5: "b", 6: "a"}.items() for t, x in enumerate(turns)]
    rows += [(7, t, "user", f"long {t}") for t in range(700)] + [(8, t, "user", f"long {t}") for t in range(600)] + [(9, None, None, None), (None, 0, "user", "x"), (2, 0, "user", "a"), (10, 5, "user", "<|im_end|>x")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("x")).withColumn("digest", F.lit(1))
    whole = {r["conv_id"]: r for r in chat.render(docs).collect()}
    assert whole[7]["n_turns"] == 700 and whole[7]["rendered"].count("<|im_start|>user\nlong ") == 700
    got = chat.render(docs, part_turns=64).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["conv_id"], r["part"])):
        by[r["conv_id"]].append(r)
    assert set(by) == {2, 4, 5, 7, 9, 10}
    assert by[2][0]["rendered"] == "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in (("user", "a"), ("assistant", "b"), ("user", "c")))
    assert [r["n_turns"] for r in by[7]] == [64] * 10 + [60] and "".join(r["rendered"] for r in by[7]).count("<|im_start|>user\nlong ") == 700
    assert by[7][4]["rendered"].startswith("<|im_start|>user\nlong 256<|im_end|>")
    assert by[9][0]["rendered"] == "<|im_start|>unknown\n<|im_end|>\n" and by[10][0]["rendered"] == "<|im_start|>user\n<| im_end|>x<|im_end|>\n"
    assert sorted((r["conv_id"], r["part"], r["rendered"]) for r in chat.render(docs, part_turns=10_000).collect()) == sorted((c, 0, "".join(r["rendered"] for r in part)) for c, part in by.items())
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_against_brute_force(spark):
    # null and equal turn numbers, repeated rows, very long texts, snapshots over partition borders
    rng = random.Random(21)
    rows, convs = [], {}
    for c in range(60):
        base = convs[rng.choice(list(convs))] if convs and rng.random() < 0.6 else []
        turns = list(base[: rng.choice([len(base), rng.randrange(len(base) + 1)])])
        turns += [(rng.choice([None, 0, 1, 5]) if not turns else max(t[0] or 0 for t in turns) + rng.choice([0, 1]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "x" * 100_000])) for _ in range(rng.choice([0, 1, 3, 40]) or (not turns))]
        convs[c] = turns
        rows += [(c, *t) for t in turns for _ in range(rng.choice([1, 1, 2]))]
    rows += [(500, None, "user", f"t{i}") for i in range(900)] + [(501, None, "user", f"t{i}") for i in range(900)] + [(502, 7, "user", "again")] * 500
    rng.shuffle(rows)
    sha = lambda r, x: hashlib.sha256(f"{r}\n{x}".encode()).digest()
    of = defaultdict(set)
    for c, t, r, x in rows:
        r, x = r or "unknown", x or ""
        of[c].add((t is not None, t or 0, r, sha(r, x), x))
    line = {c: [(r, x) for *_, r, _, x in sorted(turns)] for c, turns in of.items()}
    kept = {c: v for c, v in line.items() if not any(w[: len(v)] == v and (len(w) > len(v) or d < c) for d, w in line.items() if d != c)}
    want = {c: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in v) for c, v in kept.items()}
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    for most in (1024, 20):
        got = defaultdict(list)
        for r in sorted(chat.render(docs, part_turns=most).collect(), key=lambda r: r["part"]):
            got[r["conv_id"]].append(r["rendered"])
        assert {c: "".join(v) for c, v in got.items()} == want
        assert all(len(got[c]) == -(-len(v) // most) for c, v in kept.items())


# -- 7 mixing


def level_brute(sizes, share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in free}
        target |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return target


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(1, 90), "en", rng.choice(["a", "a", "a", "b", "c", "Z", None, "ä"]), 1) for i in range(3000)] + [(9000, "", "en", "empty", 0), (9001, None, "en", "empty", 0), (5, "w w", "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("old"))
    out = mixing.repetitions(docs).toPandas()
    out["source"] = out["source"].where(out["source"].notna(), None)
    sizes = out.groupby("source", dropna=False)["size"].sum()
    sizes = {None if pd.isna(k) else k: int(v) for k, v in sizes.items()}
    want = level_brute(sizes)
    for s, part in out.groupby("source", dropna=False):
        s = None if pd.isna(s) else s
        assert np.allclose(part["target"], want[s]) and (part["source_size"] == sizes[s]).all() and (part["copies"] <= 2).all()
        if sizes[s]:
            assert abs((part["size"] * part["copies"]).sum() - want[s]) < 0.12 * want[s] + 60
    assert len(out) == len(rows) and abs(out.groupby("source", dropna=False)["target"].first().sum() - 1.5 * sum(sizes.values())) < 1e-6
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == out["copies"].sum()
    assert mixing.mix(docs).exceptAll(mixed).count() == 0
    # the caller's columns stay as they are, whatever their names
    named = docs.withColumns({"size": F.lit(777), "_copy": F.lit("keep"), "rate": F.lit("r")}).withColumn("x.y", F.lit(3))
    kept = mixing.mix(named)
    assert kept.columns == named.columns and {tuple(r)[5:] for r in kept.collect()} == {(777, "keep", "r", 3)} and kept.count() == mixed.count()
    assert mixing.mix(docs.limit(0)).count() == 0
    known = mixing.repetitions(spark.createDataFrame(rows, DOCS).select("doc_id", "source", mixing.word_count(F.col("text")).alias("words")), size_col="words").toPandas()
    assert known["copies"].sum() == out["copies"].sum() and np.allclose(sorted(known["target"]), sorted(out["target"]))
    assert mixing.repetitions(spark.createDataFrame([], DOCS)).count() == 0


# -- 8 licences


def test_licences(spark):
    s = licenses.SENTENCES
    wrapped = s["mit-1"].replace(" to ", "\n to ") + "\n\n" + s["mit-2"] + "\n\n" + s["mit-3"].replace(", ", ",\n")
    rows = [(1, "x\nReleased under the MIT license\ny"), (2, wrapped), (3, "\n\n".join((s["mit-2"], s["mit-1"], s["mit-3"]))), (4, "Some text. Licensed under the Apache License, Version 2.0. This work is licensed under the GNU General Public License, version 3. End"), (5, "\n\n".join(s[f"bsd-{i}"] for i in (1, 2, 3, 4))), (6, "a licence to thrill"), (7, None), (8, "")]
    got = {r["doc_id"]: (r["n_sentences"], r["licenses"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("licenses", F.lit(0))).collect()}
    assert got == {1: (1, "MIT"), 2: (3, "MIT"), 3: (3, ""), 4: (2, "Apache-2.0,GPL-3.0"), 5: (4, "BSD-2-Clause,BSD-3-Clause"), 6: (0, ""), 7: (0, ""), 8: (0, "")}
    assert licenses.scan(odd(spark)).count() == len(ODD) and licenses.scan(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        licenses.known({"x": "nothing special"})


def test_wrapped_and_commented_licences(spark):
    s = licenses.SENTENCES
    gpl = """Copyright (C) 2020  X

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
    wrap = lambda text: "\n".join(textwrap.wrap(text, 60))
    mit = "\n\n".join(("MIT License\n\nCopyright (c) 2020 X", wrap(s["mit-1"]), wrap(s["mit-2"]), wrap(s["mit-3"])))
    isc = "\n\n".join(("Copyright (c) 2020 X", wrap(s["isc-1"])))
    mark = lambda text, sign: "\n".join(f"{sign} {x}".rstrip() for x in text.split("\n"))
    texts = [(gpl, 4, "GPL-3.0"), (mit, 3, "MIT"), (isc, 1, "ISC")]
    rows, want = [], {}
    for text, n, name in texts:
        for shown in (text, mark(text, "#"), mark(text, "//"), mark(text, "--"), "/*\n" + mark(text, " *") + "\n */\nint x;"):
            want[len(rows)] = (n, name)
            rows.append((len(rows), shown))
    split = s["gpl-1"].split(": ")
    for shown in (split[0] + ":\n\nNo.\n\n" + split[1] + "\n\n" + s["gpl-2"], "# not a license\n#\n# at all"):  # parts that don't follow each other
        want[len(rows)] = (1 if "WARRANTY" in shown else 0, "")
        rows.append((len(rows), shown))
    got = {r["doc_id"]: (r["n_sentences"], r["licenses"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_licences_in_hard_texts(spark):
    s = licenses.SENTENCES
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    many = s["bsd-1"] + "\n" + "Released under the MIT License.\n" * 100_000
    other = "x. Some long line of text\n" * 200_000 + s["isc-1"]
    got = {r["doc_id"]: (r["n_sentences"], r["licenses"]) for r in licenses.scan(docs([(1, many), (2, other), (3, many + "\n".join(s[f"bsd-{i}"] for i in (2, 3)))])).collect()}
    assert got == {1: (2, "MIT"), 2: (1, "ISC"), 3: (4, "BSD-2-Clause,MIT")}
    # the trigger is read as sentences are: whatever stands between its words
    own = {"x": "This is free software."}
    for text in ("This is free-software.", "This is\nFREE\n\tsoftware", "# This is free\n# software", "this is free. Software"):
        assert [r["licenses"] for r in licenses.scan(docs([(1, text)]), sentences=own, rules=(("Own", ("x",)),), triggers=("free software",)).collect()] == ["Own" if "free." not in text else ""]
    # a rule's sentences may come from whole sentences and from lines
    mixed = s["mit-1"].replace(" to ", "\n to ") + "\n\nx. " + s["mit-2"][:-1] + "\nand " + s["mit-3"] + "\n\n" + s["mit-3"]
    assert [r["licenses"] for r in licenses.scan(docs([(1, mixed)])).collect()] == ["MIT"]
    # many sentences, looked up by hash
    table = {f"n{i}": f"Licensed under the terms number {i}." for i in range(3000)}
    rows = licenses.scan(docs([(1, "\n".join(table.values())), (2, table["n7"] + " " + table["n5"])]), sentences=table, rules=(("A", ("n5", "n7")), ("B", ("n7", "n5")))).collect()
    assert {r["doc_id"]: (r["n_sentences"], r["licenses"]) for r in rows} == {1: (3000, "A"), 2: (2, "B")}


# -- 9 SentencePiece


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.model_path())


def test_pieces_equal_the_library(spark):
    lib = library()
    texts = [r[1] for r in ODD] + [" ", "a ", " a", "a  b", "▁", "▁▁x ▁", "\n \n", "日本語 テスト", "<s> </s> <0x0A>", "a\0b c\0", "   ", "tab\tand  two"]
    rng = random.Random(6)
    texts += ["".join(rng.choice("ab ▁\n\0é😀.") for _ in range(rng.randrange(40))) for _ in range(400)]
    for limit in (64 << 20, 1000):
        table = pieces.ChunkCodec(queries.model_path(), limit)
        for t in texts:
            (chunks,) = table.wanted([t or ""], 1).values()
            found, odd = table.segment(chunks)
            ids, text = table.digest(t or "", dict(zip(chunks, found)), {chunks[k]: x for k, x in odd.items()})
            want = lib.encode(t or "", add_eos=True)
            assert ids == " ".join(map(str, want)) and text == lib.decode(want)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("n_tokens", F.lit("old"))
    coded = pieces.encode(docs, queries.model_path())
    assert {r["doc_id"]: r["token_ids"] for r in coded.collect()} == {i: lib.encode(t or "", add_eos=True) for i, t in enumerate(texts)}
    back = {r["doc_id"]: r["decoded"] for r in pieces.decode(coded, queries.model_path()).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}
    got = {r["doc_id"]: r for r in pieces.round_trip(docs, queries.model_path()).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_eos=True)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
    assert pieces.round_trip(docs.limit(0), queries.model_path()).count() == 0
    shuffled = pieces.round_trip(docs.repartition(3, "doc_id"), queries.model_path(), keep=["doc_id"])
    assert shuffled.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r["doc_id"]: r["ids_sha256"] for r in shuffled.collect()} == {i: r["ids_sha256"] for i, r in got.items()}


def test_pieces_segment_each_distinct_chunk_once(spark, monkeypatch):
    """Small blocks, many of a partition, empty ones too; a whole table; chunks are learned once each."""
    lib = library()
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 2000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    empty = spark.range(0, 90, 1, 3).select((F.col("id") + 10**9).alias("doc_id"), F.lit(None).cast("string").alias("text"))
    docs = docs.unionByName(empty)
    learn = pieces.ChunkCodec._learn

    got = {r["doc_id"]: r for r in pieces.round_trip(docs, queries.model_path()).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = lib.encode(r["text"] or "", add_eos=True)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()

    table, asked = pieces.ChunkCodec(queries.model_path()), []
    monkeypatch.setattr(pieces.ChunkCodec, "_learn", lambda self, new: (asked.extend(new), learn(self, new))[1])
    blocks = [table.wanted([r["text"] or ""], 7) for r in rows]
    for bucket in range(7):
        table._forget()
        for block in blocks:
            table.segment(block.get(bucket, []))
    assert len(asked) == len(set(asked)) == len({c for r in rows for c in table._chunks(r["text"] or "")})


# -- 10 near-dedup


def shingles_brute(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def near_brute(rows):
    sets, parent = [shingles_brute(t) for _, t in rows], list(range(len(rows)))
    where = defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for j, s in enumerate(sets):
        shared = Counter(i for g in s for i in where[g])
        for i, n in shared.items():
            if 100 * n >= 75 * (len(sets[i]) + len(s) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            where[g].append(j)
    best = {}
    for j, (i, _) in enumerate(rows):
        best[root(j)] = min(best.get(root(j), i), i)
    return {i: (len(sets[j]), best[root(j)]) for j, (i, _) in enumerate(rows)}


def near_spark(spark, rows):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_near_groups_of_all_kinds(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(5000)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows, common = [], words(60)
    for _ in range(60):  # pairs around the threshold
        a = words(rng.randrange(30, 200))
        b = list(a)
        for _ in range(rng.randrange(0, 1 + len(a) // 25)):
            b[rng.randrange(len(b))] = "changed"
        rows += [" ".join(a), " ".join(b)]
    star = words(150)
    for _ in range(300):  # copies of one original, most of them far from each other
        b = list(star)
        for k in rng.sample(range(150), rng.choice([1, 2, 3, 4, 4])):
            b[k] = rng.choice(vocab)
        rows.append(" ".join(b))
    rows.append(" ".join(star))
    chain = words(80)
    for i in range(40):  # each a near copy of the one before
        chain = chain[2:] + words(2)
        rows.append(" ".join(chain))
    rows += [" ".join(words(100) + common) for _ in range(200)]  # one passage in many documents
    rows += ["few words here", "Few  words\there", "a b c d e", "A B C D E", "", " \n", None] + [" ".join(star)] * 50
    order = list(enumerate(rows))
    rng.shuffle(order)
    numbered = [(i * 7 % 10007, t) for i, t in order]
    got, want = near_spark(spark, numbered), near_brute(numbered)
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def near_dense(rows):
    """Components of non-empty texts by all pairs, as a dense product over shared shingles."""
    sets, parent = [shingles_brute(t) for _, t in rows], list(range(len(rows)))
    column = {g: k for k, g in enumerate(g for g, c in Counter(g for s in sets for g in s).items() if c > 1)}
    m, n = np.zeros((len(sets), len(column)), np.float32), np.array([len(s) for s in sets])
    for i, s in enumerate(sets):
        m[i, [column[g] for g in s if g in column]] = 1

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a in range(0, len(sets), 500):
        i, j = np.nonzero(7 * (m[a : a + 500] @ m.T) >= 3 * (n[a : a + 500, None] + n[None, :]))
        for x, y in zip((i + a).tolist(), j.tolist()):
            p, q = root(x), root(y)
            parent[max(p, q)] = min(p, q)
    best = {}
    for j, (i, _) in enumerate(rows):
        best[root(j)] = min(best.get(root(j), i), i)
    return {i: best[root(j)] for j, (i, _) in enumerate(rows)}


def test_near_groups_lose_no_link_in_template_families(spark):
    # families of three sizes whose members are too far from each other, each with near copies of some members
    rng = random.Random(17)
    vocab = [f"w{i}" for i in range(20_000)]
    texts = []
    for size in (150, 500, 1500):
        template = [rng.choice(vocab) for _ in range(300)]
        members = []
        for _ in range(size):
            member = list(template)
            for k in rng.sample(range(3, 300, 6), 7):
                member[k] = rng.choice(vocab)
            members.append(member)
        for member in members[: size // 2]:
            copy = list(member)
            for k in rng.sample(range(6, 290, 6), 6):
                copy[k] = rng.choice(vocab)
            members.append(copy)
        texts += [" ".join(x) for x in members]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {i: c for i, (_, c) in near_spark(spark, rows).items()}
    want = near_dense(rows)
    assert got == want and 900 < sum(c != i for i, c in want.items()) < 1200


def test_frequent_shingles_meet_in_cells(spark, monkeypatch):
    # all sets share six shingles, which their lengths put into the prefixes; one component is much larger than the others
    rng = np.random.default_rng(9)
    sets = {i: sorted({*range(6), *rng.choice(np.arange(100, 104), 2, False).tolist()}) for i in range(60)}
    owner = {i: 0 if i < 35 else i - i % 2 for i in sets}
    frame = spark.createDataFrame([(i, len(x), x) for i, x in sets.items()], "id long, n long, shingles array<long>")
    grouped = spark.createDataFrame(list(owner.items()), "node long, component long")
    similar = {(i, j) for i in sets for j in sets if i < j and owner[i] != owner[j] and 4 * len({*sets[i]} & {*sets[j]}) >= 3 * len({*sets[i]} | {*sets[j]})}
    found = []
    for rows in (4, 1024):
        monkeypatch.setattr(minhash, "HOT_ROWS", rows)
        found.append(sorted((r["a"], r["b"]) for r in minhash.prefix_pairs(frame, grouped).collect()))
    assert found[0] == found[1] and len(found[0]) == len(set(found[0])) and similar and similar <= set(found[0])


def test_forest_links():
    rng = np.random.default_rng(4)
    sets = [np.sort(rng.permutation(np.arange(40, dtype=np.uint64))[: 33 + k % 3]) for k in range(60)]
    ids = np.arange(60) * 7
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    a, b = np.triu_indices(60, 1)
    mark = minhash.forest_links(ids, offsets, np.concatenate(sets), ids[a], ids[b])
    similar = np.array([4 * len(np.intersect1d(sets[i], sets[j])) >= 3 * len(np.union1d(sets[i], sets[j])) for i, j in zip(a, b)])

    def groups(pairs):
        of = list(range(60))
        for i, j in pairs:
            of = [min(of[i], of[j]) if x in (of[i], of[j]) else x for x in of]
        return of

    assert not (mark & ~similar).any() and groups(zip(a[mark], b[mark])) == groups(zip(a[similar], b[similar])) and mark.sum() < similar.sum()


def test_near_dedup_odd_rows(spark):
    docs = odd(spark).withColumn("kept", F.lit("mine"))
    got = minhash.near_groups(docs).collect()
    assert len(got) == len(ODD) and [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] in (1, 2, 3, 4, 5, 8)} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 8: 4}
    out = minhash.near_dedup(docs.withColumn("x.y", F.lit(1)).withColumn("_gone", F.lit(2)))
    assert out.columns == [*docs.columns, "x.y", "_gone"] and sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 1, 2, 3, 4, 6, 7, 9, 10]
    assert minhash.near_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_forest_scan_in_small_chunks(spark, monkeypatch):
    texts = [b" ".join(b"%d" % (i // 3 * 1000 + k) for k in range(80)) + b" %d" % i for i in range(120)]
    sets = [s for run in minhash.shingle_sets(texts) for s in run]
    assert [len(s) for s in sets] == [77] * 120
    labels, sketch = minhash._labels(minhash._minima(sets))
    order = np.argsort(labels[:, 0], kind="stable")
    i, j, agree, hub = minhash.neighbours(np.zeros(120, int), labels[order, 0].view(np.uint64), np.full(120, 77), sketch[order])
    pairs = {tuple(sorted((order[a], order[b]))) for a, b in zip(i, j)}
    assert len([1 for a, b in pairs if a // 3 == b // 3]) > 100 and all(a // 3 == b // 3 for a, b in pairs)


# -- pipeline


@HAVE
def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    docs = texts_of()
    kept = set(queries.op4_quality_rules(spark, SF).filter("kept").toPandas()["doc_id"])
    rows = [(i, t) for i, t in zip(docs["doc_id"], docs["text"]) if i in kept]
    best = {}
    for i, t in rows:
        k = t.encode().translate(None, SPACE)
        best[k] = min(best.get(k, (0, 1 << 60)), (-len(t), i))
    rows = [(i, t) for i, t in rows if best[t.encode().translate(None, SPACE)][1] == i]
    near = near_brute(rows)
    rows = [(i, t) for i, t in rows if near[i][1] == i]
    source = dict(zip(docs["doc_id"], docs["source"]))
    sizes = Counter()
    for i, t in rows:
        sizes[source[i]] += len(t.encode().split())
    target, lib, want = level_brute(dict(sizes)), library(), Counter()
    for i, t in rows:
        rate = target[source[i]] / sizes[source[i]]
        draw = int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:8], 16) / 2**32
        ids = lib.encode(t, add_eos=True)
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()] += int(rate) + (draw < rate - int(rate))
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == +want and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_pipeline_stages_with_odd_rows(spark, tmp_path):
    import corpus_pipeline

    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [*ODD, (20, long, None, None, None), (21, long + " ", "en", "a", 1), (22, long + " more", "xx", "b", 1), (23, " ".join(f"v{k}" for k in range(80)), None, None, 1), (None, " ".join(f"u{k}" for k in range(80)), "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"kept": F.lit("x"), "size": F.lit(3), "component_id": F.lit(1)}).withColumn("x.y", F.lit(0))
    for name, frame in (("documents", docs), ("labels", spark.createDataFrame([(1, 1), (None, None), (20, 0)], "doc_id long, quality int"))):
        frame.write.parquet(str(tmp_path / f"{name}.parquet"))
    empty = docs.limit(0)
    ids = lambda frame: sorted(r["doc_id"] or 0 for r in frame.collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "sentencepiece":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        got = ids(out)
        if name == "quality_rules":
            assert got == [0, 20, 21, 22, 23]
        elif name == "exact_dedup":
            assert got == [0, 3, 5, 6, 7, 9, 10, 21, 22, 23]
        elif name == "minhash_near_dedup":
            assert got == [0, 0, 1, 2, 3, 4, 6, 7, 9, 10, 20, 23]
        elif name == "sentencepiece":
            assert got == sorted(r[0] or 0 for r in rows)
        else:
            assert set(got) <= {r[0] or 0 for r in rows} and max(Counter(i for i in got if i not in (0, 8)).values()) <= 2
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {None, 20, 21, 22, 23}
