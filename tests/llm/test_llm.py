"""Operators of the subpackage against brute force, round trips and held-out labels, with odd rows in every table."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terncube.llm import jaccard, langid, lines, media, mixing, neighbours, packing, runtime, secrets, urls, warc

WORD = re.compile("[^\x20\x09-\x0d]+")
random.seed(4)
VOCABULARY = ["".join(random.choices("abcdefghij", k=5)) for _ in range(400)]


def sentence(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choices(VOCABULARY, k=n))


BASE = sentence(120, 1)
EDITED = " ".join("changed" if i == 60 else w for i, w in enumerate(BASE.split()))
FAR = " ".join("x" if i % 9 == 0 else w for i, w in enumerate(BASE.split()))
TEXTS = [BASE, EDITED, BASE.upper(), FAR, None, "", " \n\t ", "one", "one", "One two", "ä ö ü", sentence(3000, 2), sentence(3000, 2) + " more", BASE, *[sentence(40, i) for i in range(10, 22)]]
ROWS = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"s{i % 2}", i) for i, t in enumerate(TEXTS)] + [(3, FAR, "en", "s1", 0), (None, BASE, None, None, 0)]
SCHEMA = "doc_id long, text string, lang string, source string, size int"  # size clashes with a result of the mix


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


class Groups:
    def __init__(self):
        self.up = {}

    def of(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.of(a)] = self.of(b)


def test_components(spark, tmp_path):
    rng, g = random.Random(1), Groups()
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(7, 7)]
    for a, b in edges:
        g.join(a, b)
    got = runtime.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long"), runtime.Scratch(spark)).collect()
    least = defaultdict(lambda: 10**9)
    for x in g.up:
        least[g.of(x)] = min(least[g.of(x)], x)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert {r["node"]: r["component"] for r in got} == {x: least[g.of(x)] for x in linked}


def test_url_filter(spark):
    page = lambda link: f'<html><head><link href="{link}" rel="canonical"></head></html>'
    rows = [
        (1, "http://A.example.com/en/1", None), (2, "http://a.example.com/en/71?x#y", ""), (3, "http://x.net/a", page("https://y.example.net/de/8&amp;1")), (4, "http://q.org/p?k=1", '<meta http-equiv="refresh" content="0; url=http://x.net/a">'),
        (5, "http://free.org/", page("/self")), (6, None, None), (7, "no scheme", "<p>"), (8, "http://example.com/en/70", page("http://bad.com/en/")), (9, "http://a.example.com", None), (9, "http://a.example.com", None), (10, "http://free.org/self", None), (11, "http://notexample.com/en/7", None),
    ]
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    got = {r["page_id"]: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    verdict = {k: r["verdict"] for k, r in got.items()}
    assert verdict == {1: "block", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "block"}
    assert (got[2]["host"], got[2]["path"], got[2]["rule"]) == ("a.example.com", "/en/71", "example.com/en/7")
    assert got[3]["rule"] is None and got[6]["host"] == got[6]["path"] == "" and got[11]["rule"] == "com/en/"
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string, html string"), rules).count() == 0


def test_links_with_dot_segments(spark):
    paths = {"/a/../b": "/b", "/a/./b/": "/a/b/", "/../../x": "/x", "/a/b/..": "/a/", "/a/.": "/a/", "/.": "/", "/a.b/..c": "/a.b/..c", "/a//../b": "/a/b"}
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r[0]: r[1] for r in rows.select("p", urls.without_dots(F.col("p"))).collect()} == paths
    pages = [(1, "http://x.net/a/b/c", '<link rel="canonical" href="../../en/../z">'), (2, "http://x.net/z", '<link rel="canonical" href="http://bad.com/en/./1">'), (3, "http://x.net/other", None)]
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    got = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules)
    assert {r["page_id"]: r["verdict"] for r in got.collect()} == {1: "block", 2: "block", 3: "allow"}


def brute_sets(texts, k):
    for t in texts:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        yield {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80), (1, 50)])
def test_jaccard(docs, none, k, num):
    m = jaccard.Measure(k, num, 100)
    sets, g = list(brute_sets([r[1] for r in ROWS], k)), Groups()
    for i, a in enumerate(sets):
        g.of(i)
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= num * len(a | b):
                g.join(i, j)
    least = defaultdict(lambda: 10**9)
    for i, r in enumerate(ROWS):
        least[g.of(i)] = min(least[g.of(i)], 10**9 if r[0] is None else r[0])
    want = Counter((r[0], len(s), least[g.of(i)] if s else r[0]) for i, (r, s) in enumerate(zip(ROWS, sets, strict=True)))
    assert Counter(map(tuple, jaccard.jaccard_components(docs, m).collect())) == want
    assert k > 1 or jaccard.jaccard_components(none, m).count() == 0


def test_jaccard_of_a_large_group(spark):
    rng = random.Random(9)
    rows = [BASE]
    for _ in range(150):
        w = BASE.split()
        for at in rng.sample(range(120), rng.randrange(1, 6)):
            w[at] = f"w{rng.randrange(10**6)}"
        rows.append(" ".join(w))
    sets, g = list(brute_sets(rows, 3)), Groups()
    for i, a in enumerate(sets):
        g.of(i)
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 90 * len(a | b):
                g.join(i, j)
    least = {}
    for i in range(len(rows)):
        least.setdefault(g.of(i), i)
    got = jaccard.jaccard_components(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert {r["doc_id"]: r["component"] for r in got.collect()} == {i: least[g.of(i)] for i in range(len(rows))}


def test_trigram_queries():
    assert secrets.trigram_query("abcd") == ("and", ("abc", "bcd"))
    assert secrets.trigram_query("[0-9a-f]+") is True
    assert secrets.trigram_query("(abc|xyz)+q") == ("or", ("abc", "xyz"))
    assert secrets.trigram_query("abc?") is True


def test_secrets(spark):
    import duckdb
    import pandas as pd

    texts = [
        'Token = "abcdefghijkl" password:short API_KEY:=x', "AKIAABCDEFGHIJKLMN AKIASHORT xAKIAAKIA0123456789", "deadbeefdeadbeef0 ab  0123456789abcdef", None, "", "é😀 secret=0123456789abcdef\nsecret: token: abcdefghijkl",
        "ghp_" + "a1B2" * 9 + " -----BEGIN RSA PRIVATE KEY----- xoxb-1234567890ab", "apikey:" + "Z" * 5000, "word " * 2000 + "passwd='hunter2hunter2'",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, kinds string")
    found = secrets.find_secrets(df)
    documents = pd.DataFrame({"doc_id": range(len(texts) + 1), "text": [*texts, texts[0]]})  # noqa: F841
    want = {r[0]: r[-1] for r in duckdb.sql(secrets.OP3_SQL).fetchall()}
    got = {r["doc_id"]: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"]) for r in found.collect()}
    assert got == want
    assert got[0] == "assign:0:21" and got[3] == got[4] == "" and got[1] == "access:0:18,access:30:48" and "private_key" in got[6]
    assert secrets.find_secrets(df.limit(0)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24)).astype("float32")
    x[700:1000] = x[5]
    rows = [(i, [float(c) for c in v], "e") for i, v in enumerate(x)]
    odd = [(2000, None, ""), (2001, [0.0] * 24, ""), (2002, [float("nan")] * 24, ""), (2003, [1.0], ""), (2004, [None] + [1.0] * 23, ""), (None, [1.0] * 24, "")]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, score string")
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert set(got) == set(range(0, 1500, 20)) and all(len(v) == 20 for v in got.values())
    y, hits = x.astype(float), 0
    for q, v in got.items():
        s = (y * y[q]).sum(1)
        order = [i for i in np.lexsort((np.arange(len(y)), -s)) if i != q][:20]
        hits += len(set(order) & set(v))
        if q in range(700, 1000):
            assert v == [i for i in [5, *range(700, 1000)] if i != q][:20]
    assert hits >= 0.9 * 20 * len(got)
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0
    assert neighbours.nearest(df.where("vec_id in (0, 1, 2)"), F.lit(True)).count() == 6


def test_neighbours_raise_their_probes(spark):
    x = np.random.default_rng(3).normal(size=(3000, 24))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, tables=4, probes=2, per_bucket=1).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = sum(len(v & {i for i in np.argsort(-(x @ x[q]), kind="stable")[:21].tolist() if i != q}) for q, v in got.items())
    assert len(got) == 150 and hits >= 0.9 * 20 * 150


def test_probes_needed():
    x = np.random.default_rng(4).normal(size=(80, 24))
    hashes = neighbours.CrossPolytope(24, float(np.linalg.norm(x, axis=1).max()), 3, 4)
    needed, held = hashes.needed(x[:40], x[40:]), hashes.buckets(x[40:])
    for n in (1, 5, 40, 200):
        met = (hashes.probes(x[:40], n) == held[:, :, None]).any((1, 2))
        assert (met == (needed <= n)).all()


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.token_file())
    got = packing.pack_documents(docs).collect()
    pieces, room = Counter(), defaultdict(list)
    for r in got:
        pieces[r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
        room[r["sequence_id"]].append((r["offset"], r["length"]))
    want = Counter()
    for r in ROWS:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for s in range(0, len(ids), 1024):
            part = ids[s : s + 1024]
            want[r[0], s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert pieces == want
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(none).count() == 0


def test_packing_generates_columns(monkeypatch):
    rng, priced, knapsack = np.random.default_rng(3), [], packing._best_patterns
    monkeypatch.setattr(packing, "_best_patterns", lambda *a: priced.append(1) or knapsack(*a))
    for n, most, generates in ((40, 1023, True), (20_000, 1023, True), (200_000, 1023, False)):
        priced.clear()
        histogram = Counter(int(v) for v in rng.integers(1, most + 1, n))
        lengths = np.array(sorted(histogram))
        demand = np.array([histogram[int(k)] for k in lengths])
        found = packing.solve(lengths, demand, 1024)
        assert priced and found.gap <= 1e-4
        assert found.generated > 0 or not generates
        assert np.abs(np.einsum("ij,i->j", found.columns, found.uses) - demand).max() < 1e-6 * demand.sum()
        assert (np.einsum("ij,j->i", found.columns, lengths) <= 1024).all() and (found.uses >= 0).all()


def test_packing_pads_little():
    rng = np.random.default_rng(3)
    histogram = dict(Counter(int(v) for v in rng.integers(1, 1024, 20000)))
    used, padded = Counter(), 0
    for pattern, uses in packing.patterns(histogram, 1024):
        total = sum(k * v for k, v in pattern.items())
        padded += uses * packing.padded_length(total, 1024)
        used.update({k: v * uses for k, v in pattern.items()})
    assert used == Counter(histogram) and sum(k * v for k, v in histogram.items()) > 0.99 * padded


def test_encoder_equals_the_tokenizer():
    encoder = packing.Encoder(packing.token_file())
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab cd's \n\t.,'_-éß²́½  \x1c12ll re've", k=60)) for _ in range(500)] + ["<|endoftext|> a <|endoftext|>", ""]
    whole = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert encoder(texts) == [np.array(e.ids, "<u4").tobytes() for e in whole]


def test_encoder_beyond_its_cache(monkeypatch):
    """Parts beyond the cache go after their batch, a failed lookup never falls back, and a worker's tasks share one encoder."""
    monkeypatch.setattr(packing, "CACHE", 40)
    encoder = packing.worker_encoder(packing.token_file())
    assert packing.worker_encoder(packing.token_file()) is encoder
    for seed in range(6):
        texts = [sentence(30, 10 * seed + i) for i in range(5)] + [sentence(30, 3), "", "<|endoftext|> a"]
        whole = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
        assert encoder(texts) == [np.array(e.ids, "<u4").tobytes() for e in whole]
        assert len(encoder.kept) <= 40
    packing.worker_encoder.cache_clear()


def test_mix(docs, none):
    got = [r.asDict() for r in mixing.mix(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, (r.asDict() for r in mixing.mix(docs.repartition(5)).collect())))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in ROWS)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    total = sum(r["size"] for r in got)
    order = sorted(by, key=lambda s: (s is None, s))
    weight, room = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, {s: 2 * sum(r["size"] for r in by[s]) for s in order}
    target, left, open_ = {}, 1.5 * total, set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        full = {s for s in open_ if share[s] > room[s]}
        if not full:
            target |= share
            break
        target |= {s: float(room[s]) for s in full}
        left -= sum(room[s] for s in full)
        open_ -= full
    for s, rows in by.items():
        assert all(abs(r["target"] - target[s]) < 1e-6 for r in rows)
        assert abs(sum(r["taken"] for r in rows) - target[s]) <= 0.5
    assert mixing.mix(none).count() == 0


def test_first_words(spark):
    got = spark.createDataFrame([(" a b\nc ", 2), ("a", 3), (None, 1)], "t string, n int").select(mixing.first_words("t", "n").alias("t")).collect()
    assert [r["t"] for r in got] == [" a b", "a", None]


def test_warc(spark):
    html = ["<p>x</p>", "<p>x</p>", None, "", "ä" * 9000, "<p>x</p>", "z"]
    rows = [(i, None if i == 4 else f"http://h/{i} \r\nX: y", h, "e") for i, h in enumerate(html)] + [(6, "u", "z", ""), (None, "u", "<p>x</p>", "")]
    archives = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, error string").repartition(2), archive_bytes=20_000).cache()
    got = warc.read_archives(archives).collect()
    assert len(got) == len(rows) and all(r["error"] is None for r in got)
    by = {r["record_id"].rsplit(":", 1)[1]: r for r in got}
    for i, h in enumerate(html):
        raw = (h or "").encode()
        assert by[str(i)]["payload_bytes"] == len(raw) and by[str(i)]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert {k for k, r in by.items() if r["record_type"] == "revisit"} == {"1", "5", "3", "null"}
    assert by["5"]["refers_to"].endswith(":0") and by["3"]["refers_to"].endswith(":2")
    content = archives.first()["content"]
    for bad in (content[:-3], content[: len(content) // 2] + b"\x00" + content[len(content) // 2 + 1 :]):
        assert warc.read_archives(spark.createDataFrame([("a", bad)], "archive string, content binary")).where("error is not null").count() > 0
    assert warc.parse(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n")["error"]
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def brute_lines(rows, k=lines.SHINGLE):
    first = {}
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).digest())):
        for no, line in enumerate(t.split("\n")):
            if line.strip():
                first.setdefault(line.strip().lower(), (i, t, no))
    keys, g = list(first), Groups()
    sets = [{s[j : j + k] for j in range(max(1, len(s) - k + 1))} for s in keys]
    for i, a in enumerate(sets):
        g.of(i)
        for j, b in enumerate(sets[:i]):
            if 10 * len(a & b) >= 8 * len(a | b):
                g.join(i, j)
    order = {w: n for n, w in enumerate(first.values())}
    win = {}
    for i, s in enumerate(keys):
        win[g.of(i)] = min(win.get(g.of(i), first[s]), first[s], key=order.get)
    kept = set(win.values())
    return lambda i, t: "\n".join(x for no, x in enumerate(t.split("\n")) if not x.strip() or (i, t, no) in kept)


def edited_lines(chars, seed):
    """A line of short words and three edits of it: a word in front, a word dropped, a word replaced."""
    rng, words = random.Random(seed), []
    while sum(map(len, words)) + len(words) < chars:
        words.append("".join(rng.choices("abcdefghijklmnop", k=rng.randint(1, 4))))
    at = rng.randrange(len(words))
    return " ".join(words), {"front": " ".join(["12", *words]), "dropped": " ".join(words[:at] + words[at + 1 :]), "replaced": " ".join(words[:at] + ["qq"] + words[at + 1 :])}


def line_recall(spark, lengths, n):
    """By length and kind of edit: pairs of similarity 0.8 or more, and those of them that share a bucket."""
    rows, links, k = [], defaultdict(list), lines.SHINGLE
    shingles = lambda t: {t[j : j + k] for j in range(max(1, len(t) - k + 1))}
    for chars in lengths:
        for seed in range(n):
            base, edits = edited_lines(chars, seed)
            for kind, text in {"base": base, **edits}.items():
                rows.append((f"{chars} {seed} {kind}", text))
                if kind != "base" and 10 * len(shingles(base) & shingles(text)) >= 8 * len(shingles(base) | shingles(text)):
                    links[chars, kind].append((f"{chars} {seed} base", f"{chars} {seed} {kind}"))
    held = defaultdict(set)
    for r in lines.buckets(spark.createDataFrame(rows, "name string, line string").repartition(4)).select("name", "buckets").collect():
        held[r["name"]].update(b for b in r["buckets"] if b is not None)
    return {of: (len(pairs), sum(bool(held[a] & held[b]) for a, b in pairs)) for of, pairs in links.items()}


def test_line_buckets_find_edits(spark):
    """All classes of length, those that sign with all shingles, with word starts and with both."""
    got = line_recall(spark, (30, 60, 95, 130, 200, 600), 60)
    print(got)
    for pairs, found in got.values():
        assert found >= 0.95 * pairs


def test_line_dedup(spark):
    long, rng = sentence(40, 77), random.Random(8)
    edits = [" ".join("zz" if rng.random() < 0.03 else w for w in long.split()) for _ in range(30)]
    rows = [(i, "\n".join([sentence(12, 500 + i), edits[i], "Short one", "", sentence(30, 900 + i % 7)])) for i in range(30)] + [(50, None), (51, ""), (52, "  \n\n"), (53, "short ONE"), (54, "a\nb\na")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, line string")
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()}
    want = brute_lines(rows)
    assert lines.dedup_lines(df).columns == df.columns
    assert got == {i: None if t is None else want(i, t) for i, t in rows}
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_of_repetitive_lines(spark):
    rows = [(i, t) for i, t in enumerate(["-" * 10, "-" * 40, "=-" * 8, "=-" * 30, "ha " * 5, "ha " * 20])]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_lines(rows)
    assert got == {i: want(i, t) for i, t in rows}
    assert got[1] == got[3] == got[5] == ""


def test_line_dedup_moves_texts_once(spark, monkeypatch):
    """Pairs of lines travel by 64-bit names, not by places, the differing shingles are written once, and the texts are looked
    up behind a sieve, which stays below the exchange."""
    made, cut = [], runtime.Scratch.cut
    monkeypatch.setattr(runtime.Scratch, "cut", lambda self, df, free=True: made.append((df.schema, df)) or cut(self, df, free))
    long = sentence(40, 77).split()
    rows = [(i, "\n".join([" ".join(long[:i] + ["zz"] + long[i + 1 :]), sentence(12, 500 + i), sentence(30, 900 + i % 3)])) for i in range(12)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_lines(rows)
    assert got == {i: want(i, t) for i, t in rows}
    pairs = [s for s, _ in made if {"a", "b"} <= set(s.names) or {"node", "component"} <= set(s.names)]
    assert pairs and not any("decimal" in f.dataType.simpleString() for s in pairs for f in s)
    assert sum("array" in f.dataType.simpleString() for s, _ in made for f in s) == 1
    texts = [df for s, df in made if set(s.names) == {"id", "place", "line"}][-1]._jdf.queryExecution().optimizedPlan().toString()
    assert texts.count("Join Inner") == 2 and texts.index("__bits") > 0


def test_sieve(spark):
    table = spark.range(20_000).select((F.col("id") * 7 - 50_000).alias("k"), F.lit("x").alias("wide.r"))
    for n in (0, 1, 300):
        wanted = spark.range(n).select((F.col("id") * 70 - 50_000).alias("w"))
        got = {r["k"] for r in runtime.sieve(table, "k", wanted).collect()}
        assert {r["w"] for r in wanted.collect()} <= got and len(got) <= n + 0.1 * 20_000
    assert runtime.sieve(table, "k", wanted).columns == table.columns


@pytest.mark.parametrize("data", [b"", b"a", bytes(range(256)) * 5, b"\xff" * 300, "é".encode() * 5000])
def test_media_round_trip(data):
    payload = media.padded(data)
    picture = media.decode(media.encode(payload))
    assert media.stored(picture) == payload and len(payload) % 64 == 0 and payload.startswith(data)
    assert picture["width"] % 8 == picture["height"] % 8 == 0


def test_zigzag():
    assert media.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]


def test_media_of_any_tables():
    """A file of two blocks in one interval, with a run of zeros and an end of block, by other tables."""
    seg = media._segment
    dc, ac = bytes([0, 2, *[0] * 14, 0, 3]), bytes([0, 3, *[0] * 14, 0x00, 0x21, 0xF0])
    bits = "01" + "101" + "01" + "1" + "00" + "00" + "10" + "01" + "0" + "00"
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    file = b"\xff\xd8" + seg(0xDB, bytes([0, 8, *[1] * 63])) + seg(0xC0, b"\x08\x00\x08\x00\x10\x01\x01\x11\x00") + seg(0xC4, b"\x00" + dc) + seg(0xC4, b"\x10" + ac) + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    coefs = media.decode(file)["parts"][0]["coefs"][:, 0]
    first, second = np.zeros(64), np.zeros(64)
    first[[0, 3]], second[[0, 19]] = (5, 1), (5, -1)
    assert coefs.tolist() == [first.tolist(), second.tolist()]
    assert media.thumbnail(media.decode(file)).tolist() == [[133, 133]]


def test_media_query(docs, none):
    got = media.read_media(media.add_media(docs)).collect()
    assert len(got) == len(ROWS) and all(r["error"] is None for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[4]["payload_sha256"] == by[5]["payload_sha256"] == hashlib.sha256(bytes(64)).hexdigest()
    assert by[0]["media_sha256"] == by[13]["media_sha256"] and by[0]["tail_crc32"] == zlib.crc32(media.padded(BASE.encode())[-64:])
    assert media.features([b"junk", None])[0][-1] and media.read_media(media.add_media(none)).count() == 0


def test_language(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(path).unionByName(spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 %% \U0001f600", "de", "s", 0), (9003, "", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    model = langid.fit(docs.where(langid.fold() != 2))
    got = langid.predict(docs, model).withColumn("fold", langid.fold()).collect()
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got if r["doc_id"] > 9000} == dict.fromkeys((9001, 9002, 9003), ("und", 0.0))
    held = [r["lang"] == r["lang_pred"] for r in got if r["fold"] == 2 and r["doc_id"] < 9000]
    assert sum(held) > 0.95 * len(held) > 0
    empty = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs.limit(5), empty).collect()} == {"und"}


def test_automaton_knows_all_substrings():
    codes = [random.Random(6).randrange(3) for _ in range(80)]
    step = langid.automaton(codes)
    for _ in range(300):
        a = random.randrange(80)
        b = random.randrange(a, 80)
        s = 0
        for c in codes[a : b + 1]:
            s = step[s][c]


def brute_language(learned, text):
    """Language and score by greedy longest matches in the learned bytes, found by searching for them."""
    low = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    data, rates = low.encode(), {}
    if not low.strip():
        return "und", 0.0
    for name, known in learned.items():
        count = 0
        for lo in range(0, len(data), langid.WINDOW):
            match, count = b"", count + 1
            for i in range(lo, min(lo + langid.WINDOW, len(data))):
                one = data[i : i + 1]
                if match + one in known:
                    match += one
                else:
                    match, count = one if one in known else b"", count + 1
        rates[name] = count / len(data)
    best = sorted(rates, key=lambda n: (rates[n], n))[:2]
    return best[0], rates[best[1]] / (rates[best[0]] + rates[best[1]])


def test_language_by_brute_force(spark):
    rng = random.Random(12)
    scripts = {"el": range(0x3B1, 0x3C9), "ru": range(0x430, 0x450), "zh": range(0x4E00, 0x59B8), "got": range(0x10330, 0x10349), "aa": range(97, 110), "bb": range(104, 122)}
    write = lambda k, n: " ".join("".join(chr(rng.choice(scripts[k])) for _ in range(rng.randint(1, 6))) for _ in range(n))
    train = [(i * 10 + j, write(k, 40), k) for i, k in enumerate(scripts) for j in range(6)]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    learned = defaultdict(list)
    for _, text, lang in train:
        learned[lang].append("".join(c if c.isalpha() else " " for c in text.lower()))
    probes = [(1000 + i, write(k, n), k) for i, (k, n) in enumerate((k, n) for k in scripts for n in (1, 5, 120))] + [(2000, write("el", 4) + " 12 " + write("aa", 3), None), (2001, "?!", None), (2002, None, None)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(spark.createDataFrame(probes, "doc_id long, text string, lang string"), model).collect()}
    at = {r[0]: r[1] for r in spark.createDataFrame(train, "doc_id long, text string, lang string").select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))).collect()}
    known = {k: b" ".join(t.encode() for _, t in sorted(zip([at[i] for i, _, lang in train if lang == k], v))) for k, v in learned.items()}
    for i, text, lang in probes:
        want = brute_language(known, text)
        assert got[i][0] == want[0] and abs(got[i][1] - want[1]) < 1e-9
        if i < 2000 and len(text) > 20:
            assert got[i][0] == lang


def test_language_learns_from_whole_texts(spark):
    rows = [(1, "ab " * 20_000, "aa"), (2, "xy " * 50, "bb"), (3, "xz " * 50, "bb")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), chars=200)
    assert model.languages == ["aa", "bb"]
    assert len(model.tables[0]) // (int(model.codes[0].max()) + 2) <= 2 * 201
