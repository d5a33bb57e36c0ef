"""Filter audit, source divergence and Order MinHash against brute force, on small tables with odd rows."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from riskgrid.llm import filter_audit, order_minhash, source_divergence
from riskgrid.llm.common import read

RANDOM = random.Random(5)
WORDS = [f"Word{chr(97 + i)}x" for i in range(26)] + ["ÉtÉ", "straße", "日本", "THE", "the"]
LONG = " ".join(f"w{i * 7 % 3000}" for i in range(5000))
TEXTS = [None, "", " \t\n", "A B C", "UPPER " * 60, "x " * 30, LONG, LONG, "a # b", "tail & " + "one two three " * 20] + [" ".join(RANDOM.choice(WORDS) for _ in range(RANDOM.choice((5, 60, 80)))) for _ in range(40)]
SCHEMA = "doc_id bigint, text string, lang string, source string, part string, n bigint, failed string"


def made():
    rows = [(i, t, (None, "en", "de")[i % 3], ("s0", "s1", None, "s2", "")[i % 5]) for i, t in enumerate(TEXTS)]
    rows += [(7, LONG, "en", "s1"), (7, LONG, "en", "s1"), (None, LONG, "en", "s0"), (None, "", None, None), (9_007_199_254_740_993, "", "fr", "s0")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", 5, "clash") for r in made()], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(3, 1, 0), (4, 0, 1), (6, 1, 1), (7, None, 1), (7, 1, None), (None, 1, 1), (30, 1, None), (31, 0, 0)]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, quality int, toxic int, part string")


def brute_audit(rows, labels):
    good, bad = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    failed = []
    for d, t, _, part in rows:
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        f = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        f["E"] = d is not None and any((x or "") == t and i is not None and i < d for i, x, _, _ in rows)
        failed.append((part or "", {k for k, v in f.items() if v}, d in good, d in bad))
    out = []
    for part in {p for p, *_ in failed}:
        own = [x for x in failed if x[0] == part]
        steps = {}
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                gone = [x for x in own if f in x[1] and not x[1] & set(order[:k])]
                steps["".join(order), k + 1] = f, (
                    sum(not x[1] & set(order[: k + 1]) for x in own), len(gone), sum(f in x[1] for x in own) - len(gone),
                    sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone),
                )
        total = Counter()
        for f, v in steps.values():
            total[f] += v[1]
        out += [(part, order, k, *v, total[f]) for (order, k), (f, v) in steps.items()]
    return sorted(out)


def test_audit_by_brute_force(docs, labels):
    got = filter_audit.filter_interactions(docs, labels).collect()
    assert sorted(tuple(r) for r in got) == brute_audit(made(), [tuple(r)[:3] for r in labels.collect()])


def test_audit_of_an_empty_table_and_without_labels(docs, labels):
    assert filter_audit.filter_interactions(docs.limit(0), labels).count() == 0
    none = filter_audit.filter_interactions(docs, labels.limit(0))
    assert none.where("good_lost + toxic_lost > 0").count() == 0 and none.count() == 4 * 600


def test_edges_of_fewer_filters(spark):
    counts = spark.createDataFrame([("p", 0, False, False, 3), ("p", 3, True, False, 2), ("p", 1, False, True, 5)], "part string, failed int, quality boolean, toxic boolean, n bigint")
    got = {(r.filter_order, r.step): r for r in filter_audit.audit(counts, ["X", "Y"]).collect()}
    assert len(got) == 4 and got["XY", 1].removed == 7 and got["XY", 2].removed == 0 and got["XY", 2].redundant == 2 and got["YX", 2].unique_fails == 5
    assert got["YX", 1].good_lost == 2 and got["XY", 1].toxic_lost == 5 and got["XY", 1].shapley == 7 + 5


def brute_divergence(rows, least, ranks):
    langs: dict = {}
    for _, t, lang, source in rows:
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        langs.setdefault(lang or "", {}).setdefault(source or "", []).append(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", folded))
    out = []
    for lang, groups in langs.items():
        df = Counter(w for ds in groups.values() for d in ds for w in set(d))
        kept = sorted(w for w, n in df.items() if n >= least)
        counts = {s: Counter(w for d in ds for w in d if df[w] >= least) for s, ds in groups.items()}
        whole = sum(counts.values(), Counter())

        def share(c, w, v=len(kept)):
            return 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * v)

        for s, c in counts.items():
            pairs = [(-sum(abs(share(c, w) - share(o, w)) for w in kept), t.encode(), t) for t, o in counts.items() if t != s]
            own = [(share(whole, w) - share(c, w), w.encode(), w) for w in kept if c[w] and share(c, w) > share(whole, w)]
            for part, found, most in (("pair", pairs, None), ("term", own, ranks)):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(sorted(found)[:most])]
    return sorted(out)


@pytest.mark.parametrize(("least", "ranks", "block", "seats", "most"), [(3, 50, 4, 3, 256), (2, 2, 1000, 1, 1), (1, 4, 5, 2, 256), (99, 50, 8, 8, 2)])
def test_divergence_by_brute_force(docs, least, ranks, block, seats, most):
    got = source_divergence.divergence(docs, least, ranks, block, seats, most).collect()
    assert sorted(tuple(r) for r in got) == brute_divergence(made(), least, ranks)


def test_divergence_of_an_empty_table(docs):
    assert source_divergence.divergence(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", range(1, 10))
def test_every_pair_of_seats_meets_once(spark, n):
    from pyspark.sql import functions as F

    rows = spark.range(n).select(F.col("id").cast("int").alias("seat"), F.lit(n).alias("n")).withColumn("g", F.explode(source_divergence.visits(F.col("seat"), F.col("n")))).select("seat", "g.*").toDF("a", "round", "b").collect()
    assert sorted(tuple(sorted((r.a, r.b))) for r in rows) == list(itertools.combinations(range(n), 2))
    for k in {r.round for r in rows}:
        busy = [x for r in rows if r["round"] == k for x in (r.a, r.b)]
        assert len(busy) == len(set(busy))


def test_vectors_and_shares_are_exact():
    rng = np.random.default_rng(3)
    for n in (0, 1, 500):
        at = np.sort(rng.choice(100_000, n, replace=False))
        count = rng.integers(1, 2**52, n) >> rng.integers(0, 52, n)
        a, b = source_divergence.unpack(source_divergence.pack(at, count))
        assert a.tolist() == at.tolist() and b.tolist() == count.tolist()
    for total in (1, 7, 10**9, 2**53 - 1):
        n = np.unique(np.r_[0, total, rng.integers(0, total + 1, 50)])
        assert source_divergence.shares(n, total).tolist() == [1 + math.floor(Fraction(10**9 * int(x), total)) for x in n]


def brute_signature(text, k=order_minhash.K, m=order_minhash.SKETCHES, size=order_minhash.TUPLE):
    """The definition, one k-mer and one function at a time."""
    mask = 2**64 - 1

    def mixed(x):
        x = (x ^ x >> 32) * 0x9E3779B97F4A7C15 & mask
        return x ^ x >> 29

    grams = [text[i : i + k] for i in range(max(1, len(text) - k + 1))] if text else []
    if not grams:
        return [0] * m
    hashes, seen, own = [], Counter(), []
    for g in grams:
        h = 0
        for c in g:
            h = (h * 0x5851F42D4C957F2D + ord(c) + 1) & mask
        hashes.append(mixed(h))
        own.append(mixed(hashes[-1] + seen[g] * 0xD6E8FEB86659FD93 & mask) & 0xFFFFFFFF)
        seen[g] += 1
    out = []
    for j in range(1, m + 1):
        odd = mixed(j * 0xD6E8FEB86659FD93 & mask) & 0xFFFFFFFF | 1
        taken = sorted(sorted(range(len(grams)), key=lambda i: (own[i] * odd & 0xFFFFFFFF, i))[:size])
        x = len(taken)
        for i in taken:
            x = mixed((x * 0x5851F42D4C957F2D + hashes[i]) & mask)
        out.append(x >> 13 & 0xFFFF)
    return out


@pytest.mark.parametrize("text", ["", "a", "short", "exactly 10", "ab" * 40, "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "Ünïcode ▁ 日本語 \x00 x 🎈🎈🎈🎈🎈🎈🎈🎈🎈🎈🎈🎈", LONG[:900]])
def test_signature_by_its_definition(text):
    assert order_minhash.signature(text).tolist() == brute_signature(text)


def test_signature_of_a_long_text_is_the_same_in_small_parts(monkeypatch):
    whole = order_minhash.signature(LONG)
    monkeypatch.setattr(order_minhash, "HELD", 1000)
    assert (order_minhash.signature(LONG) == whole).all() and (whole != 0).any()


def test_likeness_follows_edits():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(900)]
    base = " ".join(words)
    sign = order_minhash.signature(base)
    turned = " ".join(words[450:] + words[:450])
    mirrored = " ".join(reversed(words))
    near = [order_minhash.likeness(sign, order_minhash.signature(" ".join(words[: 900 - n] + ["zzz"] * n))) for n in (0, 45, 225, 900)]
    assert near[0] == 1 and near[0] > near[1] > near[2] > near[3] == 0
    # the same k-mers in another order are less alike
    assert order_minhash.likeness(sign, order_minhash.signature(turned)) < 0.8
    assert order_minhash.likeness(sign, order_minhash.signature(mirrored)) < 0.2


def brute_edited(rows):
    out = []
    for i, (d, t, _, _) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(t) // 4
        new = t[: len(t) - n] + nxt[:n]
        a, b, c = (np.array(brute_signature(x) if len(x) < 2000 else order_minhash.signature(x)) for x in (t, new, nxt))
        out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), "".join(f"{x:04x}" for x in a), "".join(f"{x:04x}" for x in b), float((a == b).mean()), float((a == c).mean())))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", ["1", "3", "40"])
def test_edited_by_brute_force(spark, docs, parts):
    rows = sorted((r for r in made() if r[0] is not None), key=lambda r: r[0])
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = order_minhash.edited(docs.where("doc_id is not null")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert sorted((tuple(r) for r in got), key=str) == brute_edited(rows)


def test_edited_with_null_ids_one_row_and_none(docs):
    whole = order_minhash.edited(docs).collect()
    assert len(whole) == docs.count() and sum(r.doc_id is None for r in whole) == 2
    one = order_minhash.edited(docs.where("doc_id = 6")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert order_minhash.edited(docs.limit(0)).count() == 0


def test_fingerprints_of_equal_texts_are_equal(docs):
    got = {}
    for r in order_minhash.fingerprints(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        assert got.setdefault(r.text or "", r.fingerprint) == r.fingerprint
    assert len(set(got.values())) == len(got)


def test_given_documents(spark, sf_dir):
    """Edited texts are nearer than the next document's."""
    rows = order_minhash.edited(read(spark, sf_dir, "documents")).where("n_chars > 400").collect()
    assert sum(r.near_edited > r.near_next for r in rows) > 0.95 * len(rows)
