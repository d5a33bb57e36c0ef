"""The methods themselves, each against enumeration or brute force on small cases."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskgrid.llm import common, components, decontamination, html_extraction, licenses, nbsvm, near_copies, quality_rules, sentence_pieces, sharding, simhash, token_store, toxicity
from riskgrid.llm.common import read, tokenizer_file
from riskgrid.llm.html_blocks import blocks
from riskgrid.llm.html_training import labelled_pages

BIG = 9007199254740993
WORDS = [f"word{i}" for i in range(500)]


# --- ids beside nulls, very long texts ------------------------------------


@pytest.mark.parametrize("run", [
    lambda d: token_store.stored(d, tokenizer_file("word_bpe_49k.json"), end_id=2),
    lambda d: sentence_pieces.encoded(d, tokenizer_file("piece_bpe_32k.model"), with_ids=False),
    lambda d: licenses.scan(d),
    lambda d: simhash.near_duplicates(d),
    lambda d: sharding.sharded(d),
    lambda d: near_copies.near_copies(d),
    lambda d: html_extraction.extract(d.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))).withColumnRenamed("page_id", "doc_id"),
    lambda d: decontamination.contaminated(d, d.sparkSession.createDataFrame([(7, "to find")], "item_id bigint, text string")),
], ids=["tokens", "pieces", "licenses", "simhash", "shards", "near", "html", "overlaps"])
def test_large_ids_stay_exact_beside_null_ids(spark, run):
    ids = [BIG, None, BIG + 2, -BIG, None, 2**63 - 1]
    docs = spark.createDataFrame([(i, f"a text to find {k} " + "x " * 100_000 * (k == 2)) for k, i in enumerate(ids)], "doc_id bigint, text string").coalesce(1)
    assert sorted(str(r.doc_id) for r in run(docs).select("doc_id").collect()) == sorted(map(str, ids))


def test_rows_come_in_short_batches(spark):
    docs = spark.createDataFrame([(i, "x") for i in range(1000)], "doc_id bigint, text string").coalesce(1)

    def make():
        def sizes(rows):
            yield {"n": [len(rows["text"])]}

        return sizes

    assert max(r.n for r in common.by_rows(docs, make, "n bigint", at_once=100).collect()) == 100


# --- SimHash tries ---------------------------------------------------------


def enumerated(words, budgets):
    label = list(range(len(words)))
    for i, j in itertools.combinations(range(len(words)), 2):
        if all(((words[i] ^ words[j]) >> (64 - d)).bit_count() <= budgets[d] for d in range(65)):
            a, b = label[i], label[j]
            label = [min(a, b) if x == max(a, b) else x for x in label]
    return label


@pytest.mark.parametrize("seed", range(12))
def test_trie_join_is_all_pairs(seed):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(12)]
    words = sorted(w ^ sum(1 << b for b in r.sample(range(64), r.randrange(6))) for w in r.choices(base, k=80))
    budgets = near_copies.BUDGETS if seed % 2 else (3,) * 65
    assert simhash.join_tries(np.array(words, np.uint64), len(words), 0, 0, budgets).label.tolist() == enumerated(words, budgets)


@pytest.mark.parametrize("leaves", [3, 1000])
def test_links_are_complete_when_subtrees_are_cut(spark, leaves):
    r = random.Random(leaves)
    base = [r.getrandbits(64) for _ in range(4)]
    words = sorted({w ^ sum(1 << b for b in r.sample(range(40), r.randrange(4))) for w in r.choices(base, k=150)})
    signed = np.array(words, np.uint64).view(np.int64).tolist()
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), leaves=leaves)
    root = {r.node: r.root for r in components.components(found).collect()}
    got = [root.get(x, x) for x in signed]
    want = enumerated(words, (3,) * 65)
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i, j in itertools.combinations(range(len(words)), 2))


def test_near_copies_are_all_pairs_of_similar_sets(spark):
    """A group of many near copies, pairs just above and below the similarity, exact copies, odd rows."""
    r = random.Random(4)

    def changed(words, n):
        at = r.sample(range(5, len(words) - 5), n)
        return [f"new{r.random()}" if i in at else w for i, w in enumerate(words)]

    base = [[r.choice(WORDS) for _ in range(150)] for _ in range(30)]
    texts = [" ".join(w) for w in base] + [" ".join(changed(w, k % 5)) for k, w in enumerate(base)]
    texts += [" ".join(changed(base[0], 1 + k % 2)) for k in range(60)] + [texts[3], texts[3], None, "", "one two", "one two"]
    rows = list(enumerate(texts))
    sets = [frozenset(near_copies.shingles(t).tolist()) for t in texts]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = label[i], label[j]
            label = [min(a, b) if x == max(a, b) else x for x in label]
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == label


def test_repeated_ids_keep_the_least_row(spark):
    rows = [(1, "one text of its own", "b"), (1, "one text of its own", "a"), (2, "quite another one", "c")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    assert sorted(map(tuple, kept.collect())) == [rows[1], rows[2]]


# --- directly addressable codes -------------------------------------------


@pytest.mark.parametrize("most", [200, 60_000, 2**32 - 1])
def test_every_token_is_found_by_its_place(most):
    r = random.Random(most)
    lengths = [0, 1, 700, 0, 513, 5]
    ids = np.array([r.randrange(r.choice([250, most])) for _ in range(sum(lengths))], np.uint32)
    block = token_store.Block(token_store.encode_block(list(range(6)), lengths, ids, 10))
    assert [block.id_at(i) for i in range(len(ids))] == ids.tolist()
    cuts = np.cumsum([0, *lengths])
    assert all(block.document(k).tolist() == ids[cuts[k] : cuts[k + 1]].tolist() for k in range(6))
    for _ in range(200):
        a, b = sorted(r.choices(range(len(ids) + 1), k=2))
        assert block.span(a, b).tolist() == ids[a:b].tolist()


def test_tokens_of_a_store_by_place(spark):
    docs = spark.createDataFrame([(i, " ".join(WORDS[i * 3 : i * 3 + 40])) for i in range(60)], "doc_id bigint, text string")
    path = common.fresh_path(spark, "test-store")
    token_store.write_store(docs.repartition(3), path, tokenizer_file("word_bpe_49k.json"), end_id=2, block_ids=300)
    every = [x for r in sorted(token_store.read_store(spark, path).collect(), key=lambda r: r.start) for x in r.ids]
    places = [0, 1, 299, 300, 301, len(every) - 1, len(every), -1, *range(0, len(every), 97)]
    got = token_store.token_at(spark, path, spark.createDataFrame([(p,) for p in places], "place bigint"))
    assert {r.place: r.id for r in got.collect()} == {p: every[p] for p in places if 0 <= p < len(every)}


ODD_PARTS = ["word", "Word.", "don't", "it's.", "a.b", "x...", "x.-", "...", "7a", "42.", "É", "été", "straße,", "İ", "ΟΔΟΣ", "e\u0301", ".\u0301", "\u0301", "\u212a", "日本語", "\x01", "a\x01b", "\x1c", "\x85", "\xa0", "\u2028", "\x00", "<|", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext", "|>", "\t", "\n", " ", "  ", "zq" * 40, "ÿß", "ª", "µ", "ŉ", "'s", "😀", "½"]


@pytest.mark.parametrize("known", [0, 5, 600_000])
def test_pieces_are_encoded_as_whole_texts(known, monkeypatch):
    monkeypatch.setattr(token_store, "KNOWN", known)
    own = token_store.Encoder(tokenizer_file("word_bpe_49k.json"))
    assert own.by_piece and own.letters is not own.library
    r = random.Random(known)
    texts = ["", " ", "."] + ODD_PARTS + [r.choice(["", " ", " "]).join(r.choices(ODD_PARTS, k=r.randrange(12))) for _ in range(3000)]
    array = pa.array(texts)
    got = [x for a in range(0, len(texts), 500) for x in own.texts(array.slice(a, 500))]
    assert got == [own.plain(t) for t in texts]
    assert own.texts(array[:0]) == []
    assert len(own.known) <= max(known, 1)


def test_letters_skip_the_normalizer_and_documents_share_a_span(monkeypatch):
    """What a long tail of new words costs: only pieces other than small letters go through all steps, each once; a block is read by few spans."""
    own = token_store.Encoder(tokenizer_file("word_bpe_49k.json"))
    seen = []

    class Counted:
        def encode_batch_fast(self, texts, **kw):
            seen.extend(x for t in texts for x in t.split(f" {token_store.GAP} "))
            return library.encode_batch_fast(texts, **kw)

    library, own.library = own.library, Counted()
    words = ["".join(w) for w in itertools.product("aeiß", "aei", repeat=2)]
    own.texts(pa.array([" ".join(f"{w} {w}, {w}!" for w in words) + " x-1 x-1"] * 3))
    assert sorted(seen) == ["!", ",", "x-1"]
    lengths = [0, 3, 700, 0, 513, 5]
    ids = np.arange(sum(lengths), dtype=np.uint32) * 97
    block = token_store.Block(token_store.encode_block(list(range(6)), lengths, ids, 0))
    spans = []
    monkeypatch.setattr(block, "span", lambda a, b: spans.append((a, b)) or token_store.Block.span(block, a, b))
    cuts = np.cumsum([0, *lengths])
    for a, b in [(0, 6), (1, 5), (2, 3), (3, 4), (6, 6)]:
        assert [x.tolist() for x in block.documents(a, b)] == [ids[cuts[k] : cuts[k + 1]].tolist() for k in range(a, b)]
    assert len(spans) == 5


# --- classifiers -----------------------------------------------------------


def test_ratios_by_hand():
    rows = [np.array([0, 1]), np.array([0]), np.array([1, 2]), np.array([3])]
    got = nbsvm.log_count_ratio(rows, np.array([1, 1, 0, 0]), 4)
    assert np.allclose(got, np.log([3 / 1, 2 / 2, 1 / 2, 1 / 2]))
    drawn = nbsvm.log_count_ratio(rows, np.array([1, 1, 0, 0]), 4, errors=0.5)
    assert np.allclose(drawn, [np.log(3) - 0.5 * np.sqrt(1 / 3 + 1), 0, -(np.log(2) - 0.5 * np.sqrt(1.5)) if np.log(2) > 0.5 * np.sqrt(1.5) else 0, -(np.log(2) - 0.5 * np.sqrt(1.5)) if np.log(2) > 0.5 * np.sqrt(1.5) else 0])


def test_dual_coordinate_descent_reaches_the_optimum():
    """The dual it maximises equals the primal of its weights: no other point is better."""
    r = np.random.default_rng(0)
    rows = [np.flatnonzero(r.random(30) < 0.4) for _ in range(60)]
    y = np.array([int(len(x) and x[0] < 2) for x in rows])
    ratio, c = r.normal(size=30) + 0.1, 0.7
    scaled = nbsvm.dual_coordinate_descent(rows, ratio, y, c, 2000)
    x = np.zeros((60, 30))
    for k, own in enumerate(rows):
        x[k, own] = ratio[own] / (np.sqrt((ratio[own] ** 2).sum() + 1e-12))
    w = scaled / ratio
    box = np.where(y == 1, c / (2 * y.mean()), c / (2 * (1 - y.mean())))
    sign = 2 * y - 1

    def primal(v):
        return 0.5 * v @ v + (box * np.maximum(0, 1 - sign * (x @ v))).sum()

    best = primal(w)
    for _ in range(300):
        assert primal(w + r.normal(size=30) * 10 ** -r.uniform(1, 4)) >= best * (1 - 1e-4)


def test_character_grams_are_of_letters_in_any_script():
    f = nbsvm.Features(orders=(2,), bits=20, lower=True)
    seen = np.zeros(f.size, bool)
    assert f.of("ÀÉ", seen).tolist() == f.of("àé", seen).tolist()
    assert len(f.of("日本語", seen)) == 5 and len(f.of("", seen)) == 1 and f.of(None, seen).tolist() == f.of("", seen).tolist()
    long = "".join(chr(97 + i * i % 23) for i in range(5000))
    assert len(f.of(long, seen)) == len(set(zip(f" {long}", f"{long} ", strict=True))) + 1 and not seen.any()


def test_conflicting_labels_have_one_outcome(spark):
    docs = spark.createDataFrame([(i, f"text {i} {'bad words' if i % 2 else 'fine words'}") for i in range(40)], "doc_id bigint, text string")
    labels = [(i, i % 2) for i in range(40)] + [(i, 0) for i in range(1, 40, 4)] + [(None, 1), (3, None)]
    a, b = (toxicity.classify(docs, spark.createDataFrame(x, "doc_id bigint, toxic int")).toPandas() for x in (labels, labels[::-1]))
    assert a.sort_values("doc_id").score.tolist() == b.sort_values("doc_id").score.tolist()


# --- quality rules ---------------------------------------------------------


def test_quality_ratio_and_verdict_by_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in read(spark, sf_dir, "documents").collect()] + [(10**6, None), (10**6 + 1, "w " * 60)]
    trusted = {r.doc_id for r in read(spark, sf_dir, "labels").where("quality = 1").collect()}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, spark.createDataFrame([(i,) for i in trusted], "doc_id bigint")).collect()}
    words = sorted({w for _, t in rows for w in _words(t)})
    pairs = sorted({p for _, t in rows for p in zip(_words(t), _words(t)[1:], strict=False)})
    one = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    two = {(r.a, r.b): r.h for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.xxhash64(F.xxhash64("a"), F.xxhash64("b")).alias("h")).collect()}

    def grams(text):
        w = _words(text)
        return [one[x] % quality_rules.BUCKETS for x in w] + [two[p] % quality_rules.BUCKETS for p in zip(w, w[1:], strict=False)]

    target, raw = np.zeros(quality_rules.BUCKETS), np.zeros(quality_rules.BUCKETS)
    good = {t or "" for i, t in rows if i in trusted}
    for t in {t or "" for _, t in rows}:
        np.add.at(raw, grams(t), 1)
        if t in good:
            np.add.at(target, grams(t), 1)
    ratio = np.round(1e6 * (np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))))
    verdicts = set()
    for i, t in rows:
        g = grams(t)
        total = ratio[g].sum()
        assert abs(got[i].score - (total / (len(g) * 1e6) if g else 0)) < 2e-6
        if abs(total - quality_rules.THRESHOLD * 1e6 * len(g)) > len(g):
            verdicts.add(got[i].kept)
            assert got[i].kept == (not got[i].base_failed and total >= quality_rules.THRESHOLD * 1e6 * len(g))
    assert verdicts == {True, False}


def _words(text):
    return [w.decode() for w in (text or "").encode().split()]


# --- HTML extraction -------------------------------------------------------


def test_chain_sums_and_best_path_by_enumeration():
    r = np.random.default_rng(1)
    sizes = np.array([1, 4, 3])
    unary, step = r.normal(size=8), r.normal(size=(2, 2))
    p1, expected, total = html_extraction.marginals(unary, step, sizes)
    want_p, want_e, at = np.zeros(8), np.zeros((2, 2)), 0
    chain = html_extraction.Chain({}, step, 0.0)
    for k, n in enumerate(sizes):
        own = unary[at : at + n]
        scores = {ys: sum(own[i] * y for i, y in enumerate(ys)) + sum(step[a, b] for a, b in zip(ys, ys[1:], strict=False)) for ys in itertools.product((0, 1), repeat=int(n))}
        z = np.log(sum(np.exp(s) for s in scores.values()))
        assert np.isclose(total[k], z)
        for ys, s in scores.items():
            want_p[at : at + n] += np.exp(s - z) * np.array(ys)
            for a, b in zip(ys, ys[1:], strict=False):
                want_e[a, b] += np.exp(s - z)
        chain.unary = lambda page, own=own: own.tolist()
        assert tuple(chain.labels([None] * n)) == max(scores, key=scores.get)
        at += n
    assert np.allclose(p1, want_p) and np.allclose(expected, want_e)


def test_leaf_blocks():
    def texts(page):
        return [b.text for b in blocks(page)]

    assert texts(None) == texts("") == texts("<div> \n</div>") == []
    assert texts("a<p>b <b>c</b>\n d<p>e<div>f</div>g") == ["a", "b c d", "e", "f", "g"]
    assert texts("a &amp; b&nbsp;c &copy; &#8364;") == ["a & b c © €"]
    assert texts("&am<b>p;</b> &lt<i>;b</i>") == ["&amp; <;b"]
    assert texts("<ul><li>x<li>y<ul><li>z</ul><li>w</ul>") == ["x", "y", "z", "w"]
    assert texts("x<script>var a = '<p>no</p>';</script>y<!-- <p>no -->z<style>p{}</style>") == ["xyz"]
    assert texts("1 < 2 <unknown a='>'>b</unknown></p>c") == ["1 < 2 b", "c"]
    assert [f for f in blocks('<div class="siteNav"><ul><li><a>x</a>')[0].above.features() if f.startswith(("named", "leaf", "path"))] == ["leaf=li", "path=ul/li", "named=site", "named=nav"]


def test_deep_pages_are_read_in_one_pass():
    chain = html_extraction.trained()
    for page in ("<div>x " * 30_000, "<p><td>" + "<b>" * 30_000 + "<h1>x</h1>" * 3000, "<svg/>" * 30_000, '<a "' * 3000):
        html_extraction.main_text(page, chain)


PAGE = """<html><head><title>T</title><script>if (a<b) {}</script></head><body>
<div id="cookie-banner">We use cookies. <button>OK</button></div>
<header class="site-header"><a href="/">Name</a><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav></header>
<main><article><h1>Bridges of the town</h1><p>The first bridge was built
 of wood &amp; stone, and it stood for two hundred years.</p><p>It was followed by a <a href="/x">second</a> one in the year of the flood.</p>
<div class="ad">Buy now! Sponsored</div><ul><li>The old bridge near the mill</li><li>The new bridge near the market</li></ul></article>
<div class="comments"><h3>Comments</h3><div class="comment">Nice, thanks for it</div></div></main>
<aside class="sidebar"><h3>Popular</h3><a href="/y">Ten things</a></aside>
<form class="newsletter"><label>Email</label><input><button>Subscribe</button></form>
<footer>&copy; 2020 Name. All rights reserved.</footer></body></html>"""


def test_a_page_written_by_hand():
    want = ["Bridges of the town", "The first bridge was built of wood & stone, and it stood for two hundred years.", "It was followed by a second one in the year of the flood.", "The old bridge near the mill", "The new bridge near the market"]
    assert html_extraction.main_text(PAGE, html_extraction.trained()).split("\n\n") == want


def test_extraction_on_pages_it_did_not_see(spark, sf_dir):
    chain = html_extraction.trained()
    pages = labelled_pages(200, seed=99)
    same = [a == v for p in pages for a, (_, v) in zip(chain.labels([b for b, _ in p]), p, strict=True)]
    assert sum(same) > 0.99 * len(same)
    # pages of the tables that mark the article by its tag alone: what stands in it
    seen = right = 0
    for r in read(spark, sf_dir, "pages").collect():
        if (r.html or "").count("<article") == 1 and "</article>" in r.html:
            inner = r.html[r.html.index("<article") : r.html.index("</article>")]
            if not any(w in inner for w in ("class=", "<nav", "<form", "<aside", "<footer")):
                seen += 1
                right += html_extraction.main_text(r.html, chain) == "\n\n".join(b.text for b in blocks(inner))
    assert seen >= 10 and right >= 0.95 * seen


# --- decontamination -------------------------------------------------------


def test_overlaps_by_brute_force():
    """Whether each text and item overlap at all, against every diagonal and span."""
    r = random.Random(0)
    few = [f"w{i}" for i in range(40)]
    items = [[r.choice(few) for _ in range(n)] for n in (5, 12, 13, 14, 18, 25, 40, 60)] + [["a"] * 30]
    texts = []
    for k in range(120):
        own = list(r.choice(items))
        for i in r.sample(range(len(own)), int(len(own) * r.choice([0, 0.1, 0.2, 0.3]))):
            own[i] = "zz"
        cut = r.randrange(len(own)) if k % 3 == 0 else 0
        texts.append([r.choice(few) for _ in range(r.randrange(30))] + own[cut:] + [r.choice(few) for _ in range(r.randrange(30))])
    seeds = decontamination.Seeds([(i, " ".join(w)) for i, w in enumerate(items)])
    found = {(t, k): x for t, k, *x in decontamination.overlaps(seeds, [" ".join(t) for t in texts])}
    missed = total = 0
    for t, words in enumerate(texts):
        for k, item in enumerate(items):
            want = 0
            for shift in range(-len(item) + 1, len(words)):
                a, b = max(0, shift), min(len(words), shift + len(item))
                equal = [words[i] == item[i - shift] for i in range(a, b)]
                for i in range(len(equal)):
                    if equal[i]:
                        for j in range(i + min(13, len(item)), len(equal) + 1):
                            if equal[j - 1] and sum(equal[i:j]) >= 0.8 * (j - i):
                                want = max(want, sum(equal[i:j]))
            if (t, k) in found:
                s, e, at, n = found[t, k]
                assert n == sum(words[s + i] == item[at + i] for i in range(e - s)) and n >= 0.8 * (e - s)
            if want:
                total += 1
                missed += (t, k) not in found and len(item) >= 13
            elif len(item) >= 13:
                assert (t, k) not in found or found[t, k][1] - found[t, k][0] >= len(item)
    assert total > 80 and missed <= 0.02 * total


# --- sharding --------------------------------------------------------------


def test_shards_keep_clashing_columns_and_place_repeated_rows(spark):
    rows = [(i % 7 or None, "text " * (i % 5), i, 0.5, f"s{i}", i % 2) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, size int, shard double, slot string, input_size int")
    a, b = (sharding.sharded(d, n_shards=3).toPandas() for d in (docs, docs.repartition(5, "slot")))
    assert {"input_size_", "input_shard", "input_slot", "input_size"} < set(a.columns) and len(set(a.columns)) == len(a.columns)
    key = ["input_slot", "shard", "slot"]
    assert sorted(map(tuple, a[key].values.tolist())) == sorted(map(tuple, b[key].values.tolist()))
    assert sorted(a["input_size_"]) == list(range(60)) and set(a["input_size"]) == {0, 1}


# --- licenses --------------------------------------------------------------


def test_base_phrases_by_brute_force(spark, sf_dir):
    import re

    rows = [(r.doc_id, r.text) for r in read(spark, sf_dir, "documents").collect()] + [(-1, "CC BY cc by; all rights reserved"), (-2, None)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(k, label) for k in range(len(words)) for p, label in licenses.BASE.items() if words[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(at), ",".join(sorted({x for _, x in at})))
        assert (r.first_word, r.last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


@pytest.mark.parametrize("label, notice, _", licenses.TEMPLATES)
def test_every_notice_is_found_inserted_words_and_all(label, notice, _):
    index = licenses.Index()
    words = notice.split()
    for text in (notice, f"one two three {notice} four five", " ".join([words[0], "the", "terms", *words[1:]]) if len(words) > 7 else notice.upper()):
        assert label in index.scan(text)["labels"].split(",")
    assert label not in index.scan(" ".join(words[: max(1, len(words) // 2 - 1)]))["labels"].split(",") or len(words) < 6


def test_common_words_are_no_notice():
    index = licenses.Index()
    assert index.scan("license " * 5000 + "the software is free of charge and the version 2 was released")["labels"] == ""


# --- cover of a template, against a table ----------------------------------


def test_cover_is_the_longest_common_subsequence():
    r = random.Random(3)
    for _ in range(200):
        a, b = ([bytes([97 + r.randrange(4)]) for _ in range(r.randrange(1, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert licenses.Template("", tuple(a), (), 1).cover(b) == table[-1][-1] / len(a)
