"""Licence notices that stand thousands of times in one text, and spans by brute force."""

import random
import time

from riskgrid.llm import licenses


def test_spans_by_brute_force():
    rng, spans, plain = random.Random(4), licenses.Spans(), []
    for _ in range(400):
        begin = rng.randrange(3000)
        end = begin + rng.randrange(1, 20)
        assert spans.holds(begin) == any(s <= begin < e for s, e in plain)
        assert spans.meets(begin, end) == any(s < end and begin < e for s, e in plain)
        if not spans.meets(begin, end):
            spans.add(begin, end, 1.0)
            plain.append((begin, end))
    assert list(zip(spans.starts, spans.ends, strict=True)) == sorted(plain)


def test_every_copy_of_a_notice_is_found_in_linear_time():
    index = licenses.Index()
    notice = next(t for label, t, _ in licenses.TEMPLATES if label == "zlib")
    n = len(licenses.words_of(notice))
    took = []
    for copies in (1000, 4000):
        begin = time.process_time()
        spans = index.scan(" ".join([notice, "pad " * 40] * copies))["spans"]
        took.append(time.process_time() - begin)
        assert [(s["start"], s["end"]) for s in spans if s["label"] == "zlib"] == [(k * (n + 40), k * (n + 40) + n) for k in range(copies)]
    assert took[1] < 8 * took[0] + 0.5
