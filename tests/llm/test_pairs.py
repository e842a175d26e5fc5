"""Near and exact copies, nearest neighbours and archives against brute force."""

import base64
import hashlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandline.llm import ann, common, lines, paragraphs, repeats, simhash, warc
from tests.llm.helpers import docs_of, edge_texts, words

SF = "/root/testdata/sf0.001"


def _components(nodes, links):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7), (None, 3), (300, 301)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == _components({x for e in real for x in e}, real)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_counts_bits(spark):
    text = "The quick  Brown fox\tjumps over the Lazy dog"
    ws = text.lower().split()
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]), seed=42) for i in range(len(ws) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("One two") == xxhash.xxh64_intdigest("one two", seed=42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("tile", [2048, 8])
def test_simhash_links_equal_brute_force(spark, tile):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = {int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)) for b in base for _ in range(25)}
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in fps]
    want = _components(signed, [(a, b) for a, b in combinations(signed, 2) if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3])
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), tile=tile)
    got = {r.node: r.component for r in common.components(links).collect()}
    assert {x: got.get(x, x) for x in signed} == want


def test_simhash_report_on_edge_rows(spark):
    texts = edge_texts()
    rows = simhash.report(docs_of(spark, texts)).collect()
    assert len(rows) == len(texts)
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == "0" * 16 and by[2].component_id == by[3].component_id == by[1].component_id == 1
    assert by[6].component_id == 5
    assert all(r.component_id is None for r in rows if r.doc_id is None and r.fingerprint != "0" * 16)
    kept = simhash.keep_one(docs_of(spark, texts))
    assert kept.where("doc_id = 6").count() == 0 and kept.where("doc_id IS NULL").count() == 3
    assert kept.columns == docs_of(spark, []).columns
    same = [(1, words(1, 80)), (1, words(1, 80)), (1, words(2, 80)), (2, words(2, 80)), (3, words(1, 80)), (4, words(3, 80)), (0, words(4, 80)), (4, words(4, 80))]
    assert Counter((r.doc_id, r.text) for r in simhash.keep_one(docs_of(spark, same)).collect()) == Counter([same[0], same[2], same[5], same[6]])
    assert simhash.report(docs_of(spark, [])).count() == 0


def _under(data, size, flagged):
    """Flags of the bytes under the windows of ``size`` bytes for which ``flagged`` holds."""
    edges = np.zeros(len(data) + 1, dtype=int)
    for k in range(len(data) - size + 1):
        if flagged(data[k : k + size]):
            edges[k] += 1
            edges[k + size] -= 1
    return np.cumsum(edges[:-1]) > 0


def _repeats(texts, length, passage):
    """Brute force: a counter of report rows."""
    data = [(i, (t or "").encode()) for i, t in texts]
    seen = Counter(d[k : k + length] for _, d in data for k in range(len(d) - length + 1))
    holders = {}
    for row in set(data):
        for k in range(len(row[1]) - passage + 1):
            holders.setdefault(row[1][k : k + passage], set()).add(row)
    want = Counter()
    for i, d in data:
        gone, shared = _under(d, length, lambda w: seen[w] > 1), _under(d, passage, lambda w: len(holders[w]) > 1)
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want[i, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), int(shared.sum())] += 1
    return want


@pytest.mark.parametrize(("length", "passage", "piece"), [(400, 204, 1 << 20), (60, 75, 1 << 20), (400, 204, 256), (90, 41, 64)])
def test_repeats_equal_brute_force(spark, monkeypatch, length, passage, piece):
    monkeypatch.setattr(repeats, "PIECE", piece)
    a, b, c = words(1, 300), words(2, 300), words(3, 40)
    texts = [(1, a), (2, a), (3, b[:700] + a[100:900] + "é"), (4, "x" * 1500), (5, c), (6, "ab" * 500 + b[300:1200]), (7, b[:399]), (8, b[:400]), (None, a[50:460]), (9, None), (10, "")]
    passages = [words(40 + k, 51) for k in range(3)]  # of 51 words: fewer bytes than are removed
    texts += [(20 + k, f"{words(60 + k, 40)} {passages[k % 3]} {words(70 + k, 30)}") for k in range(6)]
    texts += [(30, words(80, 100)), (30, words(80, 100)), (31, f"{words(81, 60)} {words(81, 60)}"), (None, words(82, 90)), (None, words(82, 90)), (None, f"{words(83, 9)} {words(82, 90)}")]
    got = Counter(tuple(r) for r in repeats.report(docs_of(spark, texts), length, passage).collect())
    assert got == _repeats(texts, length, passage)
    if length == 400:
        assert all(r[5] >= 204 and r[2] == 0 for r in got if r[0] is not None and 20 <= r[0] < 26)


def test_repeats_of_edge_rows_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 10_000)
    texts = edge_texts()
    got = Counter(tuple(r) for r in repeats.report(docs_of(spark, texts)).collect())
    assert got == _repeats(texts, repeats.LENGTH, repeats.PASSAGE)
    a, c = words(1, 300), words(3, 40)
    rows = [(1, a), (2, a), (5, c), (9, None), (None, a), (6, "é" * 150)]
    cut = repeats.remove(docs_of(spark, rows))
    assert cut.columns == docs_of(spark, []).columns
    by = {r.doc_id: r.text for r in cut.collect()}
    assert by[1] == by[2] == by[None] == "" and by[5] == c and by[9] is None and by[6] == "é" * 150
    assert repeats.report(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 40, 301, 302, 303])
def test_difference_cover_orders_suffixes(n):
    rng = np.random.default_rng(n)
    for values in (rng.integers(1, 3, n), rng.integers(1, 300, n), np.ones(n, dtype=np.int64), np.tile([2, 1, 1], n)[:n], rng.integers(1, 1 << 40, n)):
        assert repeats.suffix_order(values).tolist() == sorted(range(n), key=lambda k: values[k:].tolist())


def test_repeats_in_hot_blocks_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(repeats, "TILE", 4)
    core = words(1, 200)
    texts = [(k, words(100 + k, 60) + core[:450] + words(200 + k, 60)) for k in range(30)]
    got = repeats.report(docs_of(spark, texts)).collect()
    assert all(r.n_removed >= 450 for r in got)


def test_line_dedup_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lines.lines(docs)
    links = lines.verified(rows, lines.candidates(lines.signed(rows))).collect()
    found = {frozenset((r.a, r.b)) for r in links}
    sets = {r.id: frozenset(r.line[i : i + lines.SHINGLE] for i in range(len(r.line) - lines.SHINGLE + 1)) for r in rows.collect() if len(r.line) >= lines.SHINGLE}
    true = {frozenset((a, b)) for a, b in combinations(sets, 2) if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert found <= true
    joined = _components(sets, [tuple(x) for x in found])
    whole = _components(sets, [tuple(x) for x in true])
    assert np.mean([joined[a] == joined[b] for a, b in map(tuple, true)] or [1.0]) > 0.95
    assert sum(joined[x] != whole[x] for x in sets) <= 0.01 * len(sets)


def test_line_dedup_keeps_one_line_a_group(spark):
    one = "this is a line of text that will be repeated in several documents of the table"
    near = one.replace("repeated", "repeatad")
    one_set, near_set = ({x[i : i + lines.SHINGLE] for i in range(len(x) - lines.SHINGLE + 1)} for x in (one, near))
    assert len(one_set & near_set) >= lines.SIMILARITY * len(one_set | near_set)
    texts = [(3, f"{one}\nshort\n{words(1, 12)}"), (1, f"{words(2, 12)}\n  {one.upper()}\nshort"), (2, near), (4, None), (5, ""), (None, one), (6, one), (6, one), (7, "漢字" * 30)]
    got = lines.keep_first(docs_of(spark, texts))
    assert got.columns == docs_of(spark, []).columns
    by = {r.doc_id: r.text for r in got.collect()}
    assert by[1] == f"{words(2, 12)}\n  {one.upper()}\nshort" and by[3] == words(1, 12)  # the short line is document 1's
    assert by[2] == by[6] == by[5] == "" and by[4] is None and by[None] == one and by[7] == "漢字" * 30
    assert got.count() == len(texts)
    assert lines.keep_first(docs_of(spark, [])).count() == 0 and lines.report(docs_of(spark, [])).count() == 0
    plan = lines.report(docs_of(spark, texts))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize(("n", "tile"), [(150, 8), (300, lines.TILE)])
def test_line_dedup_joins_a_star_of_variants(spark, n, tile):
    centre = words(1, 30).split()
    # Each variant has another word somewhere; variants with different words replaced are near the centre only.
    texts = [" ".join(centre)] + [" ".join([*centre[: k % 30], words(10_000 + k, 1)[:6], *centre[k % 30 + 1 :]]) for k in range(n)]
    rows = lines.lines(docs_of(spark, [(k, t) for k, t in enumerate(texts)]))
    signatures = common.written(lines.signed(rows))
    sets = {r.id: frozenset(r.line[i : i + lines.SHINGLE] for i in range(len(r.line) - lines.SHINGLE + 1)) for r in rows.collect()}
    near = lambda a, b: len(sets[a] & sets[b]) >= lines.SIMILARITY * len(sets[a] | sets[b])
    hub = rows.where("doc_id = 0").first().id
    keys = {r.id: set(r["keys"]) for r in signatures.collect()}
    meant = {x for x in sets if x != hub and near(x, hub) and keys[x] & keys[hub]}
    assert len(meant) > 0.9 * n
    got = {r.node: r.component for r in lines.grouped(rows, signatures, tile=tile).collect()}
    assert {got.get(x) for x in meant} == {got[hub]}


def test_line_dedup_meets_only_lines_that_may_be_similar(spark):
    centre = words(1, 30).split()
    texts = [" ".join([*centre[: k % 30], words(10_000 + k, 1)[:6], *centre[k % 30 + 1 :]]) for k in range(90)]
    rows = lines.lines(docs_of(spark, list(enumerate(texts))))
    sets = {r.id: frozenset(r.line[i : i + lines.SHINGLE] for i in range(len(r.line) - lines.SHINGLE + 1)) for r in rows.collect()}
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sorted(sets), 2)}
    sketches = common.written(lines.sketched(rows))
    other = sketches.select(*(F.col(c).alias(f"{c}2") for c in sketches.columns))
    close = {(r.id, r.id2) for r in sketches.join(other, F.expr("id < id2")).where(lines.may_be_similar(lines.SIMILARITY)).collect()}
    assert {p for p, s in share.items() if s >= lines.SIMILARITY} <= close
    below = {p for p, s in share.items() if s < lines.SIMILARITY}
    assert len(below) > 1000 and len(below & close) < 0.3 * len(below) and min(share[p] for p in close) > 0.75
    # No component is known yet, so all members of a file meet; of those below the similarity hardly any leaves the join.
    signatures = common.written(lines.signed(rows))
    members = common.written(lines.filed(signatures))
    parts = lines.parted(rows, members, spark.createDataFrame([], "node long, component long"))
    met = {(r.a, r.b) for r in lines.others(parts).collect()}
    assert met <= close
    files = members.where("id <> lo AND id <> hi").groupBy("key").agg(F.collect_set("id").alias("ids")).collect()
    filed = {tuple(sorted(p)) for r in files for p in combinations(r.ids, 2)}
    sure = {p for p in filed if share[p] >= 0.83}
    led = {(r.a, r.b) for r in lines.led(members, signatures).collect()}
    assert sure and len(sure & (met | led)) >= 0.99 * len(sure)


def test_line_dedup_sketches_a_line_once(spark, monkeypatch):
    """Both comparisons of files of several components read one table of sketches, and all that is kept is deleted."""
    centre = words(1, 30).split()
    texts = [" ".join([*centre[: k % 30], words(10_000 + k, 1)[:6], *centre[k % 30 + 1 :]]) for k in range(90)]
    rows = lines.lines(docs_of(spark, list(enumerate(texts))))
    made, met, sketched, parted = [], [], lines.sketched, lines.parted

    def counted(*args):
        parts = parted(*args)
        met.append(parts.count())
        return parts

    monkeypatch.setattr(lines, "sketched", lambda texts: made.append(1) or sketched(texts))
    monkeypatch.setattr(lines, "parted", counted)
    # Nothing is linked, so each line is its component's first, which the first comparison has compared with all others.
    monkeypatch.setattr(lines, "verified", lambda rows, pairs, similarity: common.written(pairs.limit(0)))
    lines.grouped(rows, common.written(lines.signed(rows)))
    assert len(made) == 1 and met[0] > 100 and met[1] == 0


def test_line_similarity_counts_different_shingles(spark):
    pairs = [("abcdefg" * 9, "abcdefg" * 9 + "x"), ("ab" * 40, "ab" * 9 + "a"), ("größe " * 8, "größe " * 7), ("short", "short"), ("a" * 40, "b" * 40), (words(5, 20), words(5, 19))]
    sets = lambda t: {t[i : i + lines.SHINGLE] for i in range(len(t) - lines.SHINGLE + 1)}
    want = [1000 * len(sets(a) & sets(b)) >= 800 * len(sets(a) | sets(b)) for a, b in pairs]
    got = spark.createDataFrame(pairs, "a string, b string").select(lines._similar(F.col("a"), F.col("b"), 0.8).alias("s")).collect()
    assert [r.s for r in got] == want


def test_paragraphs_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    paras, sets = [], {}
    for r in docs.orderBy("doc_id").collect():
        for p, ws in enumerate(paragraphs.lines_of(r.text)):
            if len(ws) >= paragraphs.MIN_WORDS:
                key = b" ".join(ws)
                paras.append((r.doc_id, p, key))
                sets.setdefault(key, frozenset(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)))
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] & sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    low = _components(sets, links)
    groups = {}
    for d, p, k in paras:
        groups.setdefault(low[k], []).append((d, p))
    gone = Counter(x[0] for g in groups.values() for x in g if x != min(g))
    got = {r.doc_id: r.n_removed for r in paragraphs.report(docs).collect()}
    assert len(got) == docs.count()
    assert sum(abs(got[d] - gone[d]) for d in got) <= max(1, 0.01 * sum(gone.values()))


def test_paragraphs_of_edge_rows(spark):
    text = words(25, 60)
    texts = [*edge_texts(), (20, text + "\n" + words(30, 40)), (21, "x\n" + text.replace(text.split()[3], "changed", 1))]
    got = paragraphs.remove(docs_of(spark, texts))
    assert got.columns == docs_of(spark, []).columns and got.count() == len(texts)
    by = {r.doc_id: r.text for r in got.collect()}
    assert by[20] == text + "\n" + words(30, 40) and by[21] == "x" and by[6] == "" and by[5] == words(5, 120)
    assert paragraphs.report(docs_of(spark, [])).count() == 0


def test_shared_passages_hold_a_stretch_and_go(spark):
    passage = words(90, 51)
    rows = [(k, f"{words(100 + k, 120)} {passage} {words(200 + k, 60)}\n{words(300 + k, 30)}") for k in range(3)]
    wrapped = words(400, 40).split() + passage.split() + words(401, 40).split()
    rows.append((3, "\n".join(" ".join(wrapped[i : i + 12]) for i in range(0, len(wrapped), 12))))  # no line is a paragraph
    rows += [(4, words(500, 300)), (None, passage), (5, words(501, 45) + " " + " ".join(passage.split()[:19]))]
    docs = docs_of(spark, rows)
    by = {r.doc_id: r for r in paragraphs.report(docs).collect()}
    assert len(by) == len(rows)
    assert all(by[k].n_shared > 0 and by[k].n_repeated == 0 for k in range(4)) and [by[k].n_shared for k in (4, 5, None)] == [0, 0, 0]
    assert by[0].n_cut == 0 and all(by[k].n_cut == by[k].n_stretches and by[k].first_docs == [0] for k in (1, 2, 3))
    left = {r.doc_id: r.text for r in paragraphs.remove(docs).collect()}
    assert left[0] == rows[0][1] and left[4] == rows[4][1] and left[None] == passage
    for k in (1, 2):
        gone = set(rows[k][1].split()) - set(left[k].split())
        assert gone and gone <= set(passage.split()) and left[k].count("\n") == 1
    assert left[3].count("\n") == rows[-4][1].count("\n") and len(left[3].split()) <= len(wrapped) - paragraphs.MIN_WORDS


@pytest.mark.parametrize("n", [19, 20, 21, 49, 50, 51, 52, 120])
def test_every_shared_run_of_fifty_words_shares_a_stretch(n):
    run = words(7, n)
    texts = [f"{words(8, 33)} {run} {words(9, 3)}", f"{run} {words(10, 70)}", f"{words(11, 26)} {run}", run]
    cols = paragraphs._signed(texts)
    names = [set(zip(a.as_py(), b.as_py(), strict=True)) for a, b in zip(cols[4], cols[5], strict=True)]
    if n >= 50:
        assert all(x & y for x, y in combinations(names, 2))
    if n < paragraphs.MIN_WORDS:
        assert not any(x & y for x, y in combinations(names, 2))
    ws = texts[0].lower().encode().split()
    h = paragraphs._rolled(paragraphs._hashes(ws))
    mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    places = len(ws) - paragraphs.MIN_WORDS + 1
    width = min(paragraphs.WINNOW, places)
    assert cols[3][0].as_py() == sorted({min(range(p, p + width), key=lambda k: (int(mixed[k]) >> 24, k)) for p in range(places - width + 1)})


def test_links_span_all_similar_pairs():
    rng = np.random.default_rng(3)
    base = [rng.choice(5000, 40, replace=False) for _ in range(4)]
    sets = [np.unique(np.concatenate([rng.choice(b, 38, replace=False), rng.integers(5000, 9000, rng.integers(0, 6))])) for b in base for _ in range(12)]
    for side in (np.zeros(48, dtype=int), rng.integers(1, 3, 48)):
        meant = [(i, j) for i, j in combinations(range(48), 2) if (side[i] == 0 or side[i] != side[j]) and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
        found = list(paragraphs.spanning(sets, side, 0.8))
        assert {tuple(sorted(x)) for x in found} <= set(meant) and len(meant) > 50
        assert _components(range(48), found) == _components(range(48), meant)


def test_paragraphs_in_hot_files_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(paragraphs, "TILE", 4)
    base = words(1, 200).split()
    texts = [(k, " ".join(base[:k] + ["new"] + base[k + 1 :])) for k in range(40)]
    got = paragraphs.report(docs_of(spark, texts)).collect()
    assert sum(r.n_removed for r in got) == 39


def test_nearest_neighbours_recall_and_rules(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in v.collect()]
    got = {}
    for r in ann.report(v.withColumn("id", F.lit(1)).withColumn("v", F.lit("x"))).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    right = total = 0
    for q, x in rows:
        if q % 100:
            continue
        want = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in rows if i != q)[:10]
        mine = [got[q][k] for k in range(1, 11)]
        assert [m[1] for m in mine] == sorted(m[1] for m in mine)
        right += len({i for _, i in want} & {m[0] for m in mine})
        total += 10
        for i, s in mine:
            assert abs(s - np.sqrt(((x - dict(rows)[i]) ** 2).sum())) < 1e-12
    assert right >= 0.9 * total


@pytest.mark.parametrize("offset", [0.0, 1e8, 1e10])
def test_nearest_neighbours_far_from_the_origin(spark, offset):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 8)) + offset
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got = {}
    for r in ann.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    right = sum(len(got[q] & {int(k) for k in np.argsort(((x - x[q]) ** 2).sum(1) + np.where(np.arange(3000) == q, np.inf, 0), kind="stable")[:10]}) for q in range(0, 3000, 100))
    assert right >= 0.9 * 300


def test_nearest_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [inf, 1.0]), (None, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (200, [1.0, 2.0, 3.0]), (300, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.report(v).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 2, 1.414214), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 2, 1.414214)]
    assert ann.report(v.limit(0)).count() == 0
    many = spark.range(0, 3000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    got = ann.report(many).collect()
    assert len(got) == 300 and {r.vec_id for r in got if r.query_id == 200} == set(range(10))


def test_probe_sets_come_in_order_and_are_valid():
    sets = ann.probe_sets(5, 120)
    assert sets[0] == [] and len({tuple(s) for s in sets}) == len(sets)
    assert all(9 - x not in s for s in sets for x in s)


def _pages(spark):
    big = "<p>" + words(1, 400_000) + "</p>"
    rows = [(1, "http://a/é x", "<p>é</p>"), (2, None, None), (3, "http://b", ""), (4, "u", "<p>é</p>"), (0, "u", "\r\n\r\nWARC/1.1\r\n"), (5, "http://c", big), (5, "http://c", big), (6, "http://d", big), (None, "n", "lost")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_are_an_exact_round_trip(spark):
    pages = _pages(spark)
    pages = pages.where("page_id IS NOT NULL").distinct()
    want = {r.page_id: ((r.html or "").encode(), r.url or "") for r in pages.collect()}
    manifest = warc.write(pages, file_bytes=1 << 16)
    chunks = warc.read(manifest, chunk=1 << 18).collect()
    assert manifest.count() > 1 and max(len(c.data) for c in chunks) <= 1 << 18
    parts = {}
    for c in sorted(chunks, key=lambda c: (c.page_id, c.chunk)):
        parts.setdefault(c.page_id, []).append(c)
    assert set(parts) == set(want)
    first = {}
    for page in sorted(want):
        first.setdefault(want[page][0], page)
    for page, cs in parts.items():
        data, url = want[page]
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        origin = first[data]
        assert [c.chunk for c in cs] == list(range(len(cs))) and [c.last for c in cs] == [False] * (len(cs) - 1) + [True]
        assert cs[-1].declared_digest == sha and cs[-1].declared_bytes == len(data) and cs[0].url == url
        if origin == page:
            assert b"".join(c.data for c in cs) == data and cs[-1].digest == sha and cs[-1].refers_to is None
        else:
            assert cs[-1].record_type == "revisit" and cs[-1].refers_to == origin and not cs[-1].data


def test_archives_with_a_least_size_and_of_nothing(spark):
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.report(_pages(spark), min_bytes=100).collect())
    assert kinds == Counter({(k, "response", None): 1 for k in (0, 1, 2, 3, 4, None)} | {(5, "response", None): 2, (6, "revisit", 5): 1})
    assert warc.report(_pages(spark).limit(0)).count() == 0


def test_every_row_is_a_record(spark):
    rows = [(7, "u", "a"), (7, "u", "b"), (7, "u", "b"), (8, "u", "b"), (None, "u", "b"), (None, None, "c"), (None, None, "c"), (9, "u", None), (10, "u", "")]
    pages = spark.createDataFrame([(*r, "x", 5, "y", True, 1) for r in rows], "page_id long, url string, html string, digest string, size int, data string, __maybe boolean, first int")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.report(pages).collect())
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = Counter({(7, 1, sha("a"), "response", None): 1, (7, 1, sha("b"), "response", None): 2, (8, 1, sha("b"), "revisit", 7): 1, (None, 1, sha("b"), "revisit", 7): 1, (None, 1, sha("c"), "response", None): 2, (9, 0, sha(""), "response", None): 1, (10, 0, sha(""), "revisit", 9): 1})
    assert got == want


@pytest.mark.parametrize(("path", "kind"), [("/x/y", "local"), ("file:///x/y", "local"), ("s3a://b/c", "s3"), ("s3n://b/c", "s3")])
def test_archive_folders_of_any_store(monkeypatch, path, kind):
    monkeypatch.setenv("AWS_EC2_METADATA_DISABLED", "true")
    asked = []
    monkeypatch.setattr(warc.pafs, "FileSystem", type("Store", (), {"from_uri": staticmethod(lambda u: (asked.append(u), ("store", u))[1])}))
    warc._store(path)
    assert asked == ([path.replace("s3a:", "s3:").replace("s3n:", "s3:")] if "://" in path else [])


def test_digest_by_built_in_functions(spark):
    row = spark.createDataFrame([("hällo",)], "t string").select(warc.base32_sha1(F.col("t").cast("binary")).alias("d")).first()
    assert row.d == base64.b32encode(hashlib.sha1("hällo".encode()).digest()).decode()
