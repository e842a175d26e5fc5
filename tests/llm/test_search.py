"""URL filters, the conversation trie and ranked search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandline.llm import lexical, trie, urls
from strandline.llm.queries import URL_RULES
from tests.llm.helpers import docs_of, edge_texts, words

RULES = "host string, path string, verdict string"


# URL filters.


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest).group()
    return "".join(c.lower() if c < "\x80" else c for c in host), re.match("[^?#]*", rest[len(host) :]).group()


def judge(url, rules):
    host, path = parts(url)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if h and p is not None and v and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def many_urls(n, seed=4):
    rng = random.Random(seed)
    names = [words(k, 1) for k in range(40)]
    out = []
    for _ in range(n):
        host = ".".join([*rng.sample(names, rng.randint(0, 3)), rng.choice(["example", "Site"]), rng.choice(["net", "COM", "org"])])
        path = "".join("/" + rng.choice(names) for _ in range(rng.randint(0, 4))) + rng.choice(["", "/", "?q=/en/", "#/fr/"])
        out.append(f"http{rng.choice(['', 's'])}://{host}{path}")
    return out


EDGE_URLS = [None, "", "no scheme", "://", "http://", "http://net", "http://net/", "HTTP://NET/x", "x://a.net?/en/", "http://example.net/en/1", "http://example.net/en", "http://a..net/", "http://.net/", "http://net./",
             "http://examples.net/en/", "http://u@Example.Net/en/?x", "http://example.net:80/en/", "http://é.Org/fr/É", "http://org/fr/", "http://a://b.org/fr/", "http://x.org\n/fr/", "http://" + "a." * 3000 + "net/" + "y" * 5000]


def pages_of(spark, given):
    rows = [(k, u, "h", "r") for k, u in enumerate(given)] + [(None, "http://net/", "h", "r")] * 2
    return spark.createDataFrame(rows, "page_id long, url string, host string, rule string")


def test_contract_rules_equal_brute_force(spark):
    given = EDGE_URLS + many_urls(300)
    got = urls.report(pages_of(spark, given), spark.createDataFrame(URL_RULES, RULES)).collect()
    want = [(k, *judge(u, URL_RULES)) for k, u in enumerate(given)] + [(None, *judge("http://net/", URL_RULES))] * 2
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("max_keys", [urls.MAX_KEYS, 60])
def test_long_lists_are_exact_in_one_cascade_or_several(spark, max_keys):
    given = many_urls(2500)
    keys = sorted({parts(u) for u in given})
    rng = random.Random(1)
    rules = []
    for host, path in rng.sample(keys, 200):
        cut = host.split(".")[rng.randint(0, 1) :]
        rules.append((".".join(cut), path[: rng.randint(0, len(path))], rng.choice(urls.LISTS)))
    rules += [("other.host", "/never", "block"), ("", "/", "block"), (None, "/", "block"), ("net", None, "block"), ("net", "/", None), *rules[:5]]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string").repartition(5)
    got = urls.report(pages, spark.createDataFrame(rules, RULES), max_keys).collect()
    assert {tuple(r) for r in got} == {(k, *judge(u, rules)) for k, u in enumerate(given)} and len(got) == len(given)
    assert len({r.rule for r in got}) > 30


def test_cascade_decides_every_key_of_the_universe(spark):
    rows = spark.range(30_000).select(F.array(F.xxhash64(F.lit(1), "id")).alias("__h1"), F.array(F.xxhash64(F.lit(2), "id")).alias("__h2"), "id")
    listed = rows.where("id % 37 = 5").select(F.col("__h1")[0].alias("h1"), F.col("__h2")[0].alias("h2"))
    built = urls.cascade(listed, rows.select("__h1", "__h2"), 30_000)
    got = urls._tested(rows, (built,), (0, 1)).where("__found IS NOT NULL").agg(F.count("*"), F.sum((F.col("id") % 37 == 5).cast("int"))).first()
    assert got[0] == got[1] == listed.count() and len(built.levels) > 2
    assert sum(x.size for x in built.levels) < 16 * listed.count()


def test_filters_of_nothing_and_kept_columns(spark):
    rules = spark.createDataFrame(URL_RULES, RULES)
    assert urls.report(pages_of(spark, []).where("page_id > 0"), rules).count() == 0
    none = urls.report(pages_of(spark, ["http://net/"]), rules.limit(0)).collect()
    assert {(r.rule, r.verdict) for r in none} == {(None, "allow")}
    pages = pages_of(spark, ["http://net/", "http://example.net/en/1"])
    kept = urls.keep(pages, rules)
    assert kept.columns == pages.columns and [r.page_id for r in kept.collect()] == [1]


# Conversation trie.


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[3] for x in sorted(t)] for c, t in own.items()}
    seqs = {}
    for c, t in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(math.fmod(c, 100))
        seqs[c] = tuple(own.get(base, [])[:h] + t[h:])
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        here = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        leaves[node] = sum(leaves[k] for k in kids[node]) if kids[node] else 1
        saved[node] = here + sum(saved[k] for k in kids[node])
    out = []
    for node, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(seqs[c]) == len(node))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def conversations_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth long, up string").repartition(3)


def random_conversations(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.randint(-250, 900)
        for t in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "bot", None]) if rng.random() < 0.1 else ["user", "bot"][t % 2], rng.choice(["a", "bé", "", "ccc漢", None]) if t else rng.choice(["hi", "yo"])))
    return rows


@pytest.mark.parametrize("limit", [trie.LIMIT, 40, 1])
def test_trie_equals_brute_force(spark, limit):
    for rows in (random_conversations(1), random_conversations(2, 60)):
        got = sorted(map(tuple, trie.report(conversations_of(spark, rows), limit).collect()), key=str)
        assert got == sorted(plain_trie(rows), key=str)


def test_many_copies_and_a_very_long_conversation(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(6)]
    rows += [(5000 + c, t, "user", f"turn {t}" * 3) for c in (0, 1) for t in range(700)] + [(5002, 0, "u", "x" * 300_000), (None, 0, "u", "y"), (None, None, None, None)]
    rows += [(7000, None, None, None), (7001, 1, "", "")]
    want = plain_trie(rows)
    for limit in (trie.LIMIT, 50):
        assert sorted(map(tuple, trie.report(conversations_of(spark, rows), limit).collect()), key=str) == sorted(want, key=str)


def test_ids_of_a_class_span_chunks(spark):
    ids = [(("a", k) if k % 3 else ("b", k)) for k in range(-9000, 9000, 7)]
    got = {r["name"]: tuple(r)[1:] for r in trie._ends(spark.createDataFrame(ids, "name string, conv_id long").repartition(4)).collect()}
    for name in "ab":
        mine = sorted(k for n, k in ids if n == name)
        assert got[name] == (mine[0], len(mine), hashlib.sha256(",".join(map(str, mine)).encode()).hexdigest())


def test_no_conversations_no_trie_and_shared_prefixes(spark):
    assert trie.report(conversations_of(spark, []).where("conv_id > 0")).count() == 0
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "a"), (3, 0, "u", "z"), (4, None, "u", "a")]
    want = [r for r in plain_trie(rows) if r[1] > 0 and r[3] >= 2]
    assert sorted(map(tuple, trie.shared_prefixes(conversations_of(spark, rows)).collect())) == want


# Ranked search.


def terms(text):
    return ["".join(c.lower() if c < "\x80" else c for c in w) for w in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")]


def ranked(docs, items, k=20):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    big_n, big_l = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * big_n + 2) / (2 * f + 1))) for t, f in df.items()}
    out = []
    for item, text in items:
        q = Counter(terms(text))
        found = []
        for i, c, n in counted:
            m = 100 - 25 + (25 * n * big_n) // big_l
            s = sum(x * weight[t] * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, x in q.items() if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return out


def items_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0) for r in rows], "item_id long, text string, rank int, score double")


def many_docs(seed, n):
    rng = random.Random(seed)
    known = [words(k, 1) for k in range(60)]
    rows = [(k, " ".join(rng.choices(known, weights=[1 / (w + 1) for w in range(60)], k=rng.randint(1, 60)))) for k in range(n)]
    return rows + [(n + k, rows[k % 7][1]) for k in range(80)]  # many ties


ITEMS = [(1, "word"), (2, words(5, 10) + " " + words(1, 6)), (2, words(5, 3) * 2), (3, None), (4, ""), (5, "zzzz unknown"), (None, words(9, 4)), (6, "漢字かな交じり文 WORD Word two"), (7, words(1, 2000))]


@pytest.mark.parametrize("block", [lexical.BLOCK, 50])
def test_search_equals_brute_force(spark, block):
    known = [words(k, 1) for k in range(60)]
    asked = [(k, " ".join(random.Random(k).choices(known, k=1 + k % 9))) for k in range(25)]
    docs = many_docs(3, 900)
    got = sorted(map(tuple, lexical.report(docs_of(spark, docs).repartition(3), items_of(spark, asked), block=block).collect()))
    assert got == sorted(ranked(docs, asked))


@pytest.mark.parametrize("limit", [lexical.MAX_TERMS, 5])
def test_edge_rows_ties_and_groups_of_queries(spark, limit):
    docs = edge_texts()
    got = lexical.report(docs_of(spark, docs).repartition(3), items_of(spark, ITEMS), limit=limit).collect()
    assert sorted(map(tuple, got), key=str) == sorted(ranked(docs, ITEMS), key=str)


def test_search_stops_before_the_lists_end():
    """Impact falls fast here, so the threshold ends the search long before all documents are met."""
    import numpy as np

    n = 50_000
    at = np.arange(n + 1)
    block = lexical.Block(np.arange(n), np.zeros(n, dtype=bool), at, np.zeros(n, dtype=np.int64), np.arange(n, 0, -1))
    met = []
    scores = block.scores
    block.scores = lambda docs, weights: met.append(len(docs)) or scores(docs, weights)
    best = lexical.Best(20)
    block.search(np.array([0]), np.array([3]), best)
    assert sum(met) < 200 and best.doc.tolist() == list(range(20)) and best.score[0] == 3 * n


def test_search_of_nothing(spark):
    empty = docs_of(spark, [])
    assert lexical.report(empty, items_of(spark, ITEMS)).count() == 0
    assert lexical.report(docs_of(spark, [(1, "word")]), items_of(spark, [(1, None)])).count() == 0
    assert lexical.report(docs_of(spark, [(1, None)]), items_of(spark, ITEMS)).count() == 0
