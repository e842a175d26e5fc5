"""Packing, decontamination, language and quality: operators that work row by row."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.llm import decontaminate, langid, packing, quality
from tests.llm.helpers import DOCS, docs_of, edge_texts, words

SF = "/root/testdata/sf0.001"


def _ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_vocabulary()).encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aBcdé 'sre1²_-.,!<|>endoftext\n\t\x1c ΣςİKе́漢", max_size=24))
def test_word_cache_gives_the_tokenizers_ids(text):
    encode, form = packing.encoder(packing.default_vocabulary())
    (got,) = encode([text])
    assert form == "<u2" and packing.id_form(1 << 17) == "<u4"
    assert np.frombuffer(got, "<u2").tolist() == _ids(text)[:-1]


def test_packing_is_a_round_trip(spark):
    texts = edge_texts()
    rows = packing.pack(docs_of(spark, texts).repartition(3), window=256).collect()
    pieces = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for p in pieces:  # gapless, full sequences
        assert p.sequence_id * 256 + p.offset == at and p.length <= 256 - p.offset
        at += p.length
        assert p.ids_crc32 == zlib.crc32(np.frombuffer(p.ids, "<u2").astype("<u4").tobytes())
    want = sorted(_ids(t) for _, t in texts)
    got, doc = [], []
    for p in pieces:
        assert p.start == len(doc)
        doc += np.frombuffer(p.ids, "<u2").tolist()
        if len(doc) == p.doc_tokens:
            got.append(doc)
            doc = []
    assert not doc and sorted(got) == want
    whole = packing.sequences(packing.pack(docs_of(spark, texts), window=256)).collect()
    assert all(len(s.ids) == 2 * s.length for s in whole) and sum(s.length for s in whole) == at


def test_packing_shuffles_no_ids(spark):
    rows = packing.pack(docs_of(spark, [(k, words(k, 30)) for k in range(40)]).repartition(4))
    rows.count()
    plan = rows._jdf.queryExecution().toString()
    exchanges = [x for x in re.findall(r"(?m)^.*Exchange .*$", plan[plan.index("== Physical Plan") :]) if "ids" in x]
    assert "BroadcastHashJoin" in plan and not exchanges and "SortMergeJoin" not in plan


def test_packing_of_nothing(spark):
    assert packing.pack(docs_of(spark, [])).count() == 0


def _hits(text, items, window):
    """Brute force: every window at every place."""
    ws, hit, found = decontaminate.words(text), set(), set()
    for name, item in items:
        iw = decontaminate.words(item)
        k = min(window, len(iw))
        for a in range(len(iw) - k + 1 if k else 0):
            for i in range(len(ws) - k + 1):
                if ws[i : i + k] == iw[a : a + k]:
                    hit |= set(range(i, i + k))
                    found.add(name)
    return len(ws), len(hit), sorted(found)


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    vocabulary = ["aa", "b", "cé", "d1"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(str(k), text(n)) for k, n in enumerate([1, 2, 3, 4, 4, 5, 7, 9, 12, 0])] + [("null", None)]
    texts = [(k, text(n)) for k, n in enumerate([0, 1, 2, 3, 8, 20, 60, 200])] + [(99, None)]
    bench = spark.createDataFrame([(n, t) for n, t in items], "item_id string, text string")
    for limit in (1_000_000, 6):  # one automaton, and several shards
        got = {r.doc_id: r for r in decontaminate.report(docs_of(spark, texts), bench, window=4, limit=limit).collect()}
        for doc, t in texts:
            n, hit, found = _hits(t, items, 4)
            sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
            r = got[doc]
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(found), sha, hit > 0), doc


def test_decontamination_of_repeated_and_long_rows_and_clashing_columns(spark):
    item = words(3, 15)
    bench = spark.createDataFrame([(1, item), (1, item), (2, words(4, 4)), (None, words(6, 12))], "item_id long, text string")
    long = f"{words(7, 20_000)} {item} {words(8, 20_000)}"
    rows = [(1, long), (1, long), (2, words(4, 4)), (None, words(6, 12)), *edge_texts()]
    docs = docs_of(spark, rows).withColumns({c: F.lit(c) for c in ("n_words", "runs", "items", "__row")})
    for limit in (1_000_000, 13):
        got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontaminate.report(docs, bench, limit=limit).collect())
        items = [("1", item), ("2", words(4, 4)), ("", words(6, 12))]
        assert got == Counter((i, n, hit, len(found)) for i, (n, hit, found) in ((i, _fast_hits(t, items)) for i, t in rows))
        left = decontaminate.remove(docs, bench, limit=limit)
        assert left.columns == docs.columns and left.where("doc_id = 2 AND n_words = 'n_words'").count() == 1
        assert Counter(r.text for r in left.where("doc_id = 1 AND text IS NOT NULL").collect()) == {f"{words(7, 20_000)}  {words(8, 20_000)}": 2}


def _fast_hits(text, items, window=10):
    """Brute force over whole items at their places; fine where windows of an item occur together only."""
    ws, hit, found = decontaminate.words(text), set(), []
    for name, item in items:
        iw = decontaminate.words(item)
        k = min(window, len(iw))
        grams = {tuple(iw[a : a + k]) for a in range(len(iw) - k + 1)}
        at = [i for i in range(len(ws) - k + 1) if tuple(ws[i : i + k]) in grams]
        hit |= {x for i in at for x in range(i, i + k)}
        found += [name] * bool(at)
    return len(ws), len(hit), found


def test_decontamination_removes_spans_and_keeps_clean_rows(spark):
    item = words(3, 15)
    bench = spark.createDataFrame([(1, item.upper() + "!")], "item_id long, text string")
    clean, dirty = words(4, 100), words(5, 60) + ", " + item + ". " + words(6, 60)
    docs = docs_of(spark, [(1, clean), (2, dirty), (3, item), (None, clean), (5, None), (6, "")])
    got = {(r.doc_id, r.text) for r in decontaminate.remove(docs, bench).collect()}
    assert got == {(1, clean), (2, words(5, 60) + ", . " + words(6, 60)), (None, clean), (5, None), (6, "")}
    assert decontaminate.remove(docs, bench).columns == docs.columns
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(docs_of(spark, []), bench).count() == 0


def test_language_of_edge_rows_and_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.9
    assert all(0 <= r.score <= 1 for r in got)
    edge = langid.report(docs_of(spark, edge_texts())).collect()
    assert len(edge) == len(edge_texts())
    assert {r.doc_id: r.lang_pred for r in edge if r.doc_id in (1, 2, 3, 4)} == dict.fromkeys((1, 2, 3, 4), "und")
    assert langid.report(docs_of(spark, [])).count() == 0
    unlabelled = docs_of(spark, edge_texts()).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.report(unlabelled).collect()} == {"und"}


def _bayes(rows, texts):
    """Brute force: every language's score of every text, by plain counting of hashed n-grams."""
    size = 1 << langid.BITS
    known = [(langid.buckets(t).tolist(), lang) for t, lang in rows if lang is not None and langid.has_letters(t)]
    names = sorted({lang for _, lang in known})
    counts = {lang: Counter(x for b, got in known if got == lang for x in b) for lang in names}
    out = []
    for t in texts:
        logs = []
        for lang in names:
            total = sum(counts[lang].values()) + langid.SMOOTHING * size
            prior = math.log(sum(got == lang for _, got in known) / len(known))
            logs.append(prior + sum(math.log((counts[lang][x] + langid.SMOOTHING) / total) for x in langid.buckets(t)))
        best = max(range(len(names)), key=lambda k: logs[k])
        out.append((names[best], 1 / sum(math.exp(x - logs[best]) for x in logs)))
    return out


@pytest.mark.parametrize("most", [256, 2, 1])
def test_language_predictions_equal_brute_force(spark, most):
    rows = [(words(k, 20 + k) if k % 3 else f"{k} straße où niño " * k, "xyzwv"[k % 5]) for k in range(1, 40)] + [("12", "x"), (None, "y"), ("ab", None)]
    texts = [words(100 + k, 1 + 3 * k) for k in range(12)] + ["straße", "a", "où " * 3000]
    counts = langid.counted(spark.createDataFrame(rows, "text string, lang string"))
    asked = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(98, None, "x"), (99, "12 !", "x")], "k int, text string, lang string")
    got = {r.k: (r.lang_pred, r.score) for r in langid.predict(asked, counts, most=most).collect()}
    for k, (lang, score) in enumerate(_bayes(rows, texts)):
        assert got[k][0] == lang and abs(got[k][1] - score) < 1e-9, k
    assert got[98] == got[99] == ("und", 0.0)


def test_languages_that_tie_go_to_the_first_name(spark):
    counts = langid.counted(spark.createDataFrame([("abc abc", "b"), ("abc abc", "a"), ("abc abc", "c")], "text string, lang string"))
    for most in (256, 1):
        assert langid.predict(spark.createDataFrame([("abc",)], "text string"), counts, most=most).first().lang_pred == "a"


def test_quality_draw_is_the_k_largest_keys(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.report(docs, labels).collect()
    k = sum(r.log_weight is not None and r.log_weight >= quality.ACCEPT and r.worst_stretch >= quality.WORST for r in got)
    best = sorted((r for r in got if r.worst_stretch >= quality.WORST), key=lambda r: (-r.gumbel_key, r.doc_id))[:k]
    assert {r.doc_id for r in got if r.selected} == {r.doc_id for r in best}
    held = {r.doc_id: r for r in labels.collect()}
    bad = [r.selected for r in got if r.doc_id in held and held[r.doc_id].quality == 0]
    good = [r.selected for r in got if r.doc_id in held and held[r.doc_id].quality == 1 and held[r.doc_id].toxic == 0]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.4


def test_quality_model_equals_plain_counting(spark):
    texts = [(1, "good words here"), (2, "bad bad bad"), (3, "good here"), (4, None)]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.fit(docs_of(spark, texts), labels, bits=8)
    count = lambda ts: np.array([np.bincount(np.concatenate([quality.buckets(t, 8)[k] for t in ts]), minlength=256) for k in (0, 1)])
    raw, target = count([t for _, t in texts if t]), count(["good words here"])
    want = np.log((target + 1) / (raw / raw[0].sum() * target[0].sum() + 1))
    assert np.allclose(got, want)


def test_quality_weight_is_the_log_ratio_of_the_models(spark):
    texts = [(k, words(k % 7, 40 + k)) for k in range(30)] + [(30, words(3, 700)), (31, ""), (32, None)]
    labels = spark.createDataFrame([(k, int(k % 2 == 0), 0) for k in range(0, 20)], "doc_id long, quality int, toxic int")
    raw, target = Counter(), Counter()
    for i, t in texts:
        for k in (0, 1):
            for x in quality.buckets(t)[k].tolist():
                raw[k, x] += 1
                target[k, x] += i < 20 and i % 2 == 0
    total, scale = (sum(n for (k, _), n in c.items() if k == 0) for c in (raw, target))
    ratio = lambda k, x, s: math.log((target[k, x] + s) / (raw[k, x] / total * scale + s))
    got = {r.doc_id: r for r in quality.report(docs_of(spark, texts), labels).collect()}
    for i, t in texts:
        grams = list(zip(*quality.buckets(t).tolist(), strict=True))
        one, eight = ([max(ratio(0, a, s), ratio(1, b, s)) for a, b in grams] for s in (quality.SMOOTHING, quality.TAIL_SMOOTHING))
        worst = min((sum(min(x - quality.TAIL, 0) for x in eight[at : at + quality.STRETCH]) for at in range(0, len(grams), quality.STRETCH)), default=0)
        assert got[i].log_weight is None if not grams else abs(got[i].log_weight - sum(one)) < 1e-6
        assert abs(got[i].worst_stretch - worst) < 1e-6


def test_quality_of_edge_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = docs_of(spark, edge_texts())
    assert quality.report(docs, labels).count() == len(edge_texts())
    kept = quality.keep(docs, labels.limit(0))
    assert kept.columns == docs.columns
    assert kept.where("text IS NULL OR trim(text) = ''").count() == 0
    assert kept.where("doc_id IN (5, 7)").count() == 2
    assert quality.keep(docs_of(spark, []), labels).count() == 0


@pytest.mark.parametrize("text", [None, "", "a", "a b c"])
def test_words_of_small_texts(text):
    assert decontaminate.words(text) == re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").encode())


def test_schema_of_helper_table(spark):
    assert docs_of(spark, []).columns == [c.split()[0] for c in DOCS.split(", ")]


@pytest.mark.parametrize(("size", "step"), [("sf0.01", 1), ("sf0.1", 3)])
def test_quality_accepts_withheld_good_documents_of_any_length(spark, size, step):
    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{name}.parquet") for name in ("documents", "labels"))
    docs = docs.where(F.col("doc_id") % step == 0)
    good = {r["__target"] for r in quality.targets(labels).collect()}
    held = {i for i in good if zlib.crc32(str(i).encode()) % 2 == 0}
    ratios = quality.models(docs, labels.where(~F.col("doc_id").isin(sorted(held))))
    classes = {}
    for r in docs.where(F.col("doc_id").isin(sorted(held))).collect():
        got = quality.buckets(r.text)
        at = sum(got.shape[1] >= edge for edge in (500, 2000))
        weight, worst = quality.weights_of(got, ratios)
        classes.setdefault(at, []).append(weight is not None and weight >= quality.ACCEPT and worst >= quality.WORST)
    assert len(classes) == 3
    for at, accepted in classes.items():
        assert np.mean(accepted) >= 0.9, (at, np.mean(accepted), len(accepted))
