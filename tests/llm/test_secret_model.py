"""The secret scan's parts between base spans, its model and its growth, against brute force."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from factlake.llm import secrets

BASE = [("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 6, 2), ("access", re.compile("AKIA[A-Z0-9]+"), 20, 0), ("hex", re.compile("[0-9a-f]+"), 24, 0)]


def base_spans(text):
    return [(m.start(), m.end(), k, m[g]) for k, (_, p, least, g) in enumerate(BASE) for m in p.finditer(text) if len(m[g]) >= least]


def tokens(text):
    covered = bytearray(len(text))
    for a, e, *_ in base_spans(text):
        covered[a:e] = b"\1" * (e - a)
    out = []
    for m in re.finditer("[A-Za-z0-9]+", text):
        if m.end() - m.start() >= secrets.MIN_TOKEN:
            out += [(m.start() + x.start(), m.start() + x.end()) for x in re.finditer(b"\0+", covered[m.start() : m.end()]) if x.end() - x.start() >= secrets.MIN_TOKEN]
    return [(a, e, text[a:e]) for a, e in out]


def steps(value):
    codes = [min(ord(c), 127) for c in value]
    return zip([0, *codes], codes, strict=False)


def ratios(texts):
    random_values, ordinary = {v for t in texts for *_, v in base_spans(t) if v}, {v for t in texts for *_, v in tokens(t) if not re.search("[A-Za-z][0-9]+[A-Za-z]", v)}
    counts = []
    for values in ([*random_values], [x for v in ordinary for x in (v, v.upper())]):
        pairs = Counter(s for v in values for s in steps(v))
        first, last, total = Counter(), Counter(), sum(pairs.values())
        for (a, b), n in pairs.items():
            first[a] += n
            last[b] += n
        counts.append((pairs, first, last, total))

    def p(which, a, b):
        pairs, first, last, total = counts[which]
        alone = (last[b] + 0.5) / (total + 0.5 * 66)
        return (pairs[a, b] + 10 * alone) / (first[a] + 10)

    return lambda a, b: math.log(0.5 * p(0, a, b) + 0.5 / 66) - math.log(p(1, a, b))


def test_every_part_between_spans_is_judged_as_by_brute_force(spark):
    r = random.Random(7)
    key = lambda n, s="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(r.choice(s) for _ in range(n))
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    word = lambda k: "".join(r.choices("the and ing tion ment er un der stand al ly con re".split(), k=k))
    texts = [f"é token={hexes(32)} and {word(5)}" for _ in range(60)] + [f"{word(6)} {word(5).upper()}" for _ in range(60)]
    texts += [f"{hexes(32)}GhjKLmnQrsTuVwXyZGHJ{hexes(32)}", f"x{hexes(30)}Z{key(20)}Z{hexes(26)}{word(5)}Z{hexes(40)}G{key(15)}", f"AKIA{'B' * 20}{hexes(30)}{key(30)}", f"secret={hexes(40)}/{key(16)}", "", " ".join(f"{hexes(24)}G{key(14)}H{hexes(25)}" for _ in range(300))]
    ratio = ratios(texts)
    got = {x.doc_id: [tuple(s[c] for c in ("start", "end", "kind")) for s in x.spans] for x in secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    near = n = 0
    for i, text in enumerate(texts):
        judged = {(a, e, 3): (sum(ratio(x, y) for x, y in steps(v)), len(v)) for a, e, v in tokens(text)}
        assert {s for s in got[i] if s[2] < 3} == {s[:3] for s in base_spans(text)}
        for span, (score, length) in judged.items():
            margin = min(score - secrets.NEEDED, score - secrets.THRESHOLD * length)
            near += abs(margin) < 1e-9
            n += margin >= 0
            assert (span in got[i]) == (margin >= 0) or abs(margin) < 1e-9, (text[:80], span, margin)
        assert {s for s in got[i] if s[2] == 3} <= set(judged)
        assert got[i] == sorted(got[i], key=lambda s: (s[0], s[2]))
    assert n > 200 and near == 0
    assert tokens(texts[120]) == [(32, 52, "GhjKLmnQrsTuVwXyZGHJ")]


def test_parts_outside_spans_by_brute_force(spark):
    r = random.Random(1)
    texts = ["".join(r.choice(["AKIA", "0" * 12, "f" * 13, "token=", " ", "Xy", "Z" * 9, "é", "-", "secret: ", "A1b2"]) for _ in range(r.randint(1, 60))) for _ in range(150)]
    got = {x.doc_id: x for x in secrets.with_base_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert sorted((s.start, s.end, s.kind, s.value) for s in got[i].base) == sorted(base_spans(t))
        assert sorted(tuple(x) for x in got[i].tokens) == tokens(t)


def test_running_sums(spark):
    for n in (0, 1, 255, 256, 257, 5000):
        values = [(i * 7919) % 13 - 3 for i in range(n)]
        got = spark.createDataFrame([(values,)], "v array<bigint>").select(secrets._running(F.col("v"))).first()[0]
        assert got == [sum(values[: i + 1]) for i in range(n)]


def test_a_long_text_takes_time_in_proportion(spark):
    def seconds(n):
        text = " ".join(f"word{i:012}{'abcdef0123' * 3 if i % 5 == 0 else 'Q'}" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        spans = secrets.with_base_spans(df).select(F.size("base"), F.size("tokens")).first()
        assert spans[0] == -(-n // 5) and spans[1] == n - spans[0]
        return time.time() - began

    seconds(2_000)
    small, large = seconds(20_000), seconds(100_000)
    assert large < 30 and large < 15 * max(small, 0.5)
