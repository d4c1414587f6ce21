"""The ten operators against brute force on small tables with nulls, ties, repeats, empty and long texts."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factlake.llm import brown_lm, decontaminate, html_extract, importance, mixing, quality_rules, secrets, sharding, simhash, url_filter
from factlake.llm.common import ascii_lower, kth_largest, words
from factlake.llm.queries import BASE, span_digest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int"


def texts():
    r = random.Random(5)
    vocab = ["".join(r.choice("aeiorstnlé") for _ in range(r.randint(1, 8))) for _ in range(300)]
    out = [" ".join(r.choices(vocab, k=r.randint(60, 160))).replace(" a ", "\n") for _ in range(60)]
    out += [out[0], out[0], out[1] + " tail", "", None, " \t\n", "one", "Ünï ÉCOLE Straße ABC x", "w " * 5000, "x\n\nx\ny\nx\n" * 3, out[2].upper() + "!!"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 11 == 0 else f"src{i % 3}", None, "clash", 1) for i, t in enumerate(texts())]
    rows += [rows[3], (None, "a null id", "en", "src0", 1, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(40)] + [(None, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")


def test_ascii_lower(spark):
    for t in ("ABC É ß İ K Σς Ǆ", "plain", "ÀB", ""):
        assert spark.createDataFrame([(t,)], "t string").select(ascii_lower(F.col("t"))).first()[0] == re.sub("[A-Z]", lambda m: m[0].lower(), t)


def test_kth_largest(spark):
    values = [random.Random(1).choice((1.5, 2.5, random.Random(i).gauss(0, 1))) for i in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 2500, 5000):
        assert kth_largest(df, k) == sorted(values, reverse=True)[k - 1]


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("<p></p>", ""), ("<p>a&nbsp;b<br>c&amp;d", "a b c&d"),
    ("<html><body><nav><a href=x>Home</a></nav><div class=ad>Buy, now. Please.</div><article><h1>T</h1><p><b>One.<br><p>Two  three.</p><ul><li>x</li></ul></article><footer>&copy; f</footer>", "T One. Two three. x"),
    ("<body><div id=main class='post has-sidebar'><h2>H</h2><p>Long, long text. More text here.</p><div class=comments><p>first!</p></div></div><div class=sidebar>links, and. more</div><form>q</form>", "H Long, long text. More text here."),
    ("<main><p>kept text, here.</p><aside>no</aside><script>var x='</p>'</script></main>", "kept text, here."),
    ('<article><p title="a hidden gem">Text, here.</p><div data-state="hidden"><p>Text of like length.</p></div></article>', "Text, here. Text of like length."),
    ('<div class="content-with-sidebar"><article><p>Text of some length, here.</p></article></div><div class="sidebar"><p>Not this. Nor that, no.</p></div>', "Text of some length, here."),
    ("<article><header><h1>Title</h1></header><div class=x><p>Text of some length, here. It goes on, and on.</p><p>Another one, of like length, follows.</p></div><div class=y><p>Buy it</p></div></article>",
     "Title Text of some length, here. It goes on, and on. Another one, of like length, follows."),
    ("<div role=navigation><p>Not, this. Not, that.</p></div><div><p>Text.</p></div>", "Text."), ("<article><header><h1>A</h1></header><p>b.</p></article><header>x</header>", "A b."),
])
def test_html(page, want):
    assert html_extract.main_text(page) == want


def test_html_needs_no_names():
    """Ratios alone tell an article's sections from short ones beside it, whatever their names."""
    r = random.Random(8)
    sentence = lambda: " ".join(r.choice("aeiou") * r.randint(1, 9) for _ in range(12)) + "."
    for _ in range(50):
        name = lambda: "".join(r.choices("qxz", k=5))
        paragraphs = [" ".join(sentence() for _ in range(r.randint(2, 5))) for _ in range(6)]
        page = f'<body><div class="{name()}1">Short notice.</div><div class="{name()}2"><h1>Title</h1>' + "".join(f"<p>{p}</p>" for p in paragraphs) + f'<ul><li>item</ul></div><div class="{name()}3">Buy now</div>'
        assert html_extract.main_text(page) == " ".join(["Title", *paragraphs, "item"])


def test_html_scores_by_brute_force():
    page = "<body><div class=a><h2>Head, line</h2><p>One, two. <a href=x>three</a></p><p>Four!</p></div><div class=b><p>Five</p></div><div class=ads><p>Six, six. Six, six.</p></div>"
    blocks = [("body", "div.a|", "h2"), ("body", "div.a|", "p"), ("body", "div.a|", "p"), ("body", "div.b|", "p"), ("body", "div.ads|~", "p")]
    texts, links = ["Head, line", "One, two. three", "Four!", "Five", "Six, six. Six, six."], [0, 5, 0, 0, 0]
    assert html_extract.blocks_of(page) == list(zip(blocks, texts, links, strict=True))
    marks = [len(re.findall("[.,!]", t)) for t in texts]
    mean = lambda xs: sum(xs) / len(xs)
    fuse = lambda t, m, link: (1 - link) * math.sqrt(t * (1 + m))
    scores, best = html_extract.path_scores(blocks and html_extract.blocks_of(page))
    assert best == pytest.approx(fuse(mean([10, 15, 5]), mean(marks[:3]), 5 / 30))
    want = {blocks[1]: fuse((10 + 25 / 3) / 2, (mean(marks[1:3]) + mean(marks[:3])) / 2, 5 / 20), blocks[3]: fuse(4, 0, 0), blocks[4]: 0.1 * fuse(19, 4, 0), blocks[0]: fuse(25 / 3, mean(marks[:3]), 0)}
    assert scores == {k: pytest.approx(v) for k, v in want.items()}


def test_html_sections_by_brute_force():
    """Scores of random pages against sums over every path's text that starts with a section, path by path."""
    r, flow = random.Random(11), html_extract._FLOW
    section_of = lambda path: section_of(path[:-1]) if path and path[-1].rstrip("+~-") in flow else path
    for _ in range(30):
        labels = ["div.a|", "div.ads|~", "article+", "p", "h2", "li", "ul", "nav-", "section"]
        blocks = [(tuple(r.choices(labels, k=r.randint(0, 6))), "x" * r.randint(1, 40) + "." * r.randint(0, 3), 0) for _ in range(r.randint(1, 25))]
        shown = [b for b in blocks if "nav-" not in b[0]]
        factor = lambda p: (html_extract.GOOD if "article+" in p else 1) * (html_extract.BAD if "div.ads|~" in p else 1)
        ratios = lambda bs: (sum(len(t) for _, t, _ in bs) / len(bs), sum(t.count(".") for _, t, _ in bs) / len(bs))

        def below(section):
            ws = [(html_extract.BAD if "div.ads|~" in p else 1, t) for p, t, _ in shown if section_of(p)[: len(section)] == section]
            n = sum(w for w, _ in ws)
            return sum(w * len(t) for w, t in ws) / n, sum(w * t.count(".") for w, t in ws) / n

        scores, _ = html_extract.path_scores(blocks)
        assert set(scores) == {p for p, _, _ in shown}
        for path, score in scores.items():
            section = section_of(path)
            chars, marks = ratios([b for b in shown if b[0] == path])
            smooth, around = 0.5, below(section)
            if path and path[-1] == "h2":
                smooth, around = 1.0, max([around] + [below(section_of(section[:-1]))] * bool(section), key=lambda x: x[0])
            text, mark = ((1 - smooth) * a + smooth * b for a, b in zip((chars, marks), around, strict=True))
            assert score == pytest.approx(factor(path) * math.sqrt(text * (1 + mark)))


def test_html_broken_pages_take_linear_time():
    n = 20_000
    for page, want in (
        ("<div>" * n + "Text, here.", "Text, here."), ("<div>" * n + "x" + "</p>" * n, "x"),
        ("<li><div>" + "<x>" * n + "<li>a</li>" * n, " ".join("a" * n)), ("<div>text" * n, None),
    ):
        start = time.monotonic()
        got = html_extract.main_text(page)
        assert time.monotonic() - start < 5 and want in (got, None)


def test_html_names_of_running_text():
    """A paragraph is told by a name only if most of the name's words are telltale."""
    page = "<main><p>First one, of some length, here.</p><p class={}>A second paragraph, with marks. It goes on.</p></main>"
    assert html_extract.main_text(page.format("reply-to-critics")) == "First one, of some length, here. A second paragraph, with marks. It goes on."
    assert html_extract.main_text(page.format("newsletter-signup")) == "First one, of some length, here."


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", "<p>" + "word " * 50_000, "t"), (1, None, None, None)], "page_id long, url string, html string, text string")
    got = {r.url: (r.n_chars, len(r.text)) for r in html_extract.extract_main_text(df).collect()}
    assert got == {"u": (249_999, 249_999), None: (0, 0)} and html_extract.extract_main_text(df.limit(0)).count() == 0


def test_sharding(docs, rows):
    got = sharding.kd_shards(docs, n_shards=8).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 1
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    bytes_of = collections.Counter()
    for r in got:
        bytes_of[r.shard] += r.size
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert max(bytes_of.values()) - min(bytes_of.values()) <= 2 * max(r.size for r in got)
    assert sharding.kd_shards(docs.limit(0), n_shards=8).count() == 0
    assert {r.shard for r in sharding.kd_shards(docs, target_bytes=10**9).collect()} == {0}


def test_many_shards(spark):
    """2,000 shards of 30,000 rows: none empty, every group of copies whole, and none further from the mean than its splits allow."""
    df = spark.range(30_000).selectExpr("id doc_id", "repeat('x', cast(pmod(xxhash64(id div 2), 97) as int)) || (id div 2) text", "'common-crawl-' || id % 7 source", "cast(null as string) lang")
    got = sharding.kd_shards(df, n_shards=2000).collect()
    size, groups = collections.Counter(), collections.defaultdict(set)
    for r in got:
        size[r.shard] += r.size
        groups[r.doc_id // 2].add(r.shard)
    mean, most = sum(size.values()) / 2000, 2 * max(r.size for r in got)
    assert len(got) == 30_000 and len(size) == 2000 and all(len(x) == 1 for x in groups.values())
    assert all(abs(v - mean) <= most for v in size.values())


def test_medians_by_brute_force(spark):
    """Two shards: the boundary of the widest dimension's order that lies next to half of the bytes."""
    r = random.Random(4)
    rows = [(i, "t" * r.randint(1, 60) + str(i), f"long-common-prefix-{r.randint(0, 40):02}", "en") for i in range(300)]
    got = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), n_shards=2).collect()
    size = {i: len(t) + 1 for i, t, _, _ in rows}
    left, total = {x.doc_id for x in got if x.shard == 0}, sum(size.values())
    sources = {i: s for i, _, s, _ in rows}
    assert max(sources[i] for i in left) <= min(sources[i] for i in size if i not in left)
    assert abs(sum(size[i] for i in left) - total / 2) <= max(size.values()) / 2


def test_hot_text_is_spread_evenly(spark):
    df = spark.range(4000).selectExpr("id doc_id", "case when id % 3 > 0 then 'hot text' else concat('t', id) end text", "'s' source", "'en' lang")
    got = sharding.kd_shards(df, n_shards=8).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [r.b for r in got]
    assert len(sizes) == 8 and max(sizes) < 1.1 * min(sizes)


def brute_fingerprint(text):
    w = [x.encode() for x in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash(docs, rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    least = {}
    root = roots_of(fps)
    for (i, _), g in zip(rows, root, strict=True):
        least[g] = min(x for x in (least.get(g), i) if x is not None) if i is not None or g in least and least[g] is not None else None
    want = collections.Counter((i, f"{f:016x}", least[g]) for (i, _), f, g in zip(rows, fps, root, strict=True))
    assert collections.Counter(map(tuple, simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect())) == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({v for v in least.values() if v is not None})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_large_groups_of_near_fingerprints(spark):
    r = random.Random(3)
    base = r.getrandbits(64)
    fps = {base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for _ in range(400)} | {r.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {x.fp % (1 << 64): x.root for x in simhash.fingerprint_roots(df, bucket=16).collect()}
    groups = collections.defaultdict(set)
    for f, g in zip(fps, roots_of(fps), strict=True):
        groups[g].add(f)
    for g in groups.values():
        assert len({got.get(f, f) for f in g}) == 1
    assert len({got.get(f, f) for f in fps}) == len(groups)


def test_brown_scores(docs, rows):
    c, toks = collections.Counter(), []
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), None]
        toks.append((i, w))
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(w)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in toks)
    scored = brown_lm.score_texts(docs, head=64, paired=32, rounds=3).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in scored) == want
    assert {r.train_tokens for r in scored} == {n} and all(r.score < 0 for r in scored)
    assert brown_lm.score_texts(docs.limit(0), head=8, paired=4, rounds=1).count() == 0


def test_brown_exchange_raises_information():
    """Alternating words end in alternating classes; no round lowers the objective; the tables stay consistent."""
    rng = np.random.default_rng(1)
    k, n = 12, 3
    group = np.append([0, 1, 1, 0, 0, 0, 1, 0, 1, 1, 1, 0], [2, 2])
    pairs = np.where(group[:, None] != group, rng.integers(50, 60, (k + 2, k + 2)), rng.integers(0, 2, (k + 2, k + 2))).astype(float)
    classes, table, course = brown_lm.exchange_clusters(pairs, k, n, 20)
    assert all(a <= b + 1e-6 for a, b in zip(course, course[1:])) and course[-1] > course[0]
    want = np.zeros((n + 2, n + 2))
    np.add.at(want, (classes[:, None], classes), pairs)
    assert np.allclose(table, want)
    for w in range(k):  # no single move is better
        for c in range(n):
            other = classes.copy()
            other[w] = c
            t = np.zeros_like(want)
            np.add.at(t, (other[:, None], other), pairs)
            assert brown_lm.information(t) <= course[-1] + 1e-6
    assert not {classes[w] for w in range(k) if group[w] == 0} & {classes[w] for w in range(k) if group[w] == 1}


def test_brown_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    tokens, sizes = rng.integers(0, 50, 9).astype(float), rng.integers(0, 9, 9).astype(float)
    brackets = brown_lm.class_model(rng.integers(0, 30, (9, 9)).astype(float), tokens, sizes, int(tokens.sum()), int(sizes.sum()))
    # every class: its words' counts plus one each, and one unknown word
    assert np.allclose((10**brackets * (tokens + sizes + 1)).sum(axis=1), 1)


def test_brown_score_by_brute_force(spark):
    """The score of every text from the classes up: no bucket has enough neighbours, so words outside the paired ones are rare."""
    r = random.Random(6)
    rows = [(i, " ".join(r.choices("abcdefgh", k=r.randint(0, 12)) + [f"z{i}"])) for i in range(60)]
    got = {x.doc_id: x for x in brown_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), head=8, paired=8).collect()}
    train = [t.split() for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(w for t in train for w in t)
    names = sorted("abcdefgh", key=lambda w: (-c[w], w))
    unit = lambda w: names.index(w) if w in names else 9
    pairs = np.zeros((10, 10))
    for t in train:
        path = [8, *map(unit, t), 8]
        np.add.at(pairs, (path[:-1], path[1:]), 1)
    n_classes = round((len(c)) ** (1 / 3))
    classes, table, _ = brown_lm.exchange_clusters(pairs, 8, n_classes)
    tokens, sizes = np.zeros(n_classes + 2), np.zeros(n_classes + 2)
    for w, n in [*c.items(), (None, len(train))]:
        k = n_classes if w is None else classes[unit(w)]
        tokens[k] += n
        sizes[k] += 1
    brackets = brown_lm.class_model(table, tokens, sizes, int(tokens.sum()), int(sizes.sum()))
    for i, t in rows:
        path = [n_classes, *(classes[unit(w)] for w in t.split()), n_classes]
        want = sum(math.log10(c[w] + 1) for w in t.split()) + math.log10(len(train) + 1) + brackets[path[:-1], path[1:]].sum()
        assert got[i].score == pytest.approx(want)
        assert got[i].perplexity == pytest.approx(10 ** (-want / len(path[1:])))


def test_quality_rules(docs, rows, labels):
    got = quality_rules.quality(docs, labels, buckets=256).collect()
    want = []
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        win = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        c = collections.Counter(win)
        rep = len({k + d for k, x in enumerate(win) if c[x] > 1 for d in range(3)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((str(i), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, len(w) < 50 or 100 * rep > 50 * len(w)))
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(want)
    assert not any(r.kept and r.base_failed for r in got) and any(r.kept for r in got)
    assert quality_rules.quality(docs, labels.limit(0), buckets=64).where("kept = base_failed").count() == 0


def test_junk_is_told_from_prose(spark):
    r = random.Random(9)
    vocab = ["".join(r.choice("aeiorstnl") for _ in range(r.randint(2, 5))) for _ in range(200)]
    prose = [" ".join(r.choices(vocab, k=80)) for _ in range(300)]
    rows = [(i, " ".join(w + "&&&" for w in t.split()) if i % 6 == 0 else t) for i, t in enumerate(prose)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    for got in (importance.resample(d, lab), quality_rules.quality(d, lab)):
        kept = {x.doc_id for x in got.where("kept").collect()}
        assert not any(i % 6 == 0 for i in kept) and len(kept) >= 245
    assert importance.resampled_documents(d, lab).columns == d.columns
    assert importance.resample(d.limit(0), lab).count() == 0


PATTERNS = [("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 6, 2), ("access", re.compile("AKIA[A-Z0-9]+"), 20, 0), ("hex", re.compile("[0-9a-f]+"), 24, 0)]


def test_secrets(spark):
    r = random.Random(2)
    key = lambda n, s="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(r.choice(s) for _ in range(n))
    texts = [f"é password={key(30)} then" for _ in range(400)] + ["token=token:abcdefgh", "API_key : 'abc", "AKIA" + "A" * 16 + " AKIAB", "x" + "0" * 24, "token=abcdef" * 3, "", None, "passKword=abcdefgh"]
    syllables = "the and ing tion ment er un der stand al ly con re".split()
    texts += ["ordinary: " + "".join(r.choices(syllables, k=12)) for _ in range(300)]
    hidden = key(40)
    texts.append(f"look {hidden} here")
    got = {x.doc_id: x for x in secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", span_digest(F.col("spans")).alias("all"), span_digest(F.filter("spans", lambda s: s["kind"] < len(BASE))).alias("base")).collect()}
    for i, t in enumerate(texts):
        spans = sorted((m.start(), k, m.end(), name) for k, (name, p, least, g) in enumerate(PATTERNS) for m in p.finditer(t or "") if len(m[g]) >= least)
        assert got[i].base == ",".join(f"{n}:{a}:{e}" for a, _, e, n in spans)
    assert got[len(texts) - 1].all == f"markov:5:{5 + len(hidden)}"
    assert not any("markov" in got[i].all for i, t in enumerate(texts) if t and "ordinary" in t)


def test_secrets_in_paths_names_and_beside_hex(spark):
    """Random keys of an alphabet that no labelled secret has are found by themselves, wherever they stand; ordinary words are left alone."""
    r = random.Random(5)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    syllables = "the and ing tion ment er un der stand al ly con re".split()
    word = lambda k: "".join(r.choices(syllables, k=k))
    texts = [f"token = {r.getrandbits(128):032x} and {word(6)}" for _ in range(100)] + [f"{word(5)} {word(7).upper()} {word(4).capitalize()}Of{word(3).capitalize()} {word(4)}2024 490123456789012" for _ in range(200)]
    plain, keys = len(texts), []
    for around in ("see {} here", "GET /static/files/download/{}/index", "client_session_identifier={};", "{}0123456789abcdef0123456789"):
        for n in (20, 24, 32):
            for _ in range(10):
                keys.append("".join(r.choices(alphabet, k=n - 1)) + "Z")
                texts.append("before " + around.format(keys[-1]))
    got = {x.doc_id: [s for s in x.spans if s["kind"] == 3] for x in secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert not any(got[i] for i in range(plain))
    found = [any(texts[plain + i][s["start"] : s["end"]] == k for s in got[plain + i]) for i, k in enumerate(keys)]
    assert sum(found) >= 0.95 * len(found)


def test_secrets_edges(spark):
    rows = [(None, "password=abcdefgh"), (1, None), (1, None), (2, ""), (3, "x" * 200_000 + " AKIA" + "B" * 20), (4, "a" * 12), (4, "a" * 12)]
    got = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(x.doc_id), len([s for s in x.spans if s["kind"] < 3])) for x in got) == [("1", 0), ("1", 0), ("2", 0), ("3", 1), ("4", 0), ("4", 0), ("None", 1)]


def test_mixing(docs, rows):
    got = mixing.mix_sources(docs).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r.size
    assert len(got) == len(rows)
    for rs in by.values():
        assert sum(r.size for r in rs) == rs[0].source_size and abs(sum(r.taken for r in rs) - rs[0].target) < 3
    assert abs(sum(rs[0].target for rs in by.values()) - 1.5 * sum(r.size for r in got)) < 1e-6
    assert collections.Counter(map(tuple, mixing.mix_sources(docs).collect())) == collections.Counter(map(tuple, got))
    assert mixing.mixed_documents(docs).columns == docs.columns and mixing.mix_sources(docs.limit(0)).count() == 0


def test_decontamination(spark, docs, rows):
    long = rows and next(t for _, t in rows if t and len(t.split()) > 100)
    bench = [("a", " ".join(WORD.findall(long)[20:60])), ("b", "one"), ("c", None), ("d", "!!"), (None, "x y"), ("a", "never seen words " * 9), ("e", "w " * 13)]
    b = spark.createDataFrame(bench, "item_id string, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {(i, tuple(w[s : s + 13])) for i, t in bench if (w := split(t)) for s in range(max(len(w) - 12, 1))}
    want = []
    for i, t in rows:
        w, hit, items = split(t), set(), set()
        for item, g in windows:
            for s in range(len(w) - len(g) + 1):
                if tuple(w[s : s + len(g)]) == g:
                    hit |= set(range(s, s + len(g)))
                    items.add(item)
        items.discard(None)
        want.append((str(i), len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    for bound in (64 << 20, 0):
        got = decontaminate.contamination(docs, b, broadcast_bytes=bound).drop("row_key").collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    assert decontaminate.contamination(docs, b.limit(0)).where("contaminated").count() == 0
    assert decontaminate.drop_contaminated(docs, b).count() == sum(not x[-1] for x in want)


def test_url_filters(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.com", "/fr/x/", "block"), ("a.com", "/fr/x/", "allow")]
    hosts, paths = ["Example.org", "m.x.example.org", "notexample.org", "a.com", "b.a.com", "com", "org.", "example.org:80"], ["", "/", "/es/1", "/en/12", "/fr/x/1?y", "/de/#z", "?q", "/fr/x"]
    urls = [f"https://{h}{p}" for h in hosts for p in paths] + [None, "no scheme", "://", "http://a.com/fr/x/"] + ["https://m.x.example.org/es/hot"] * 200
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in url_filter.judge_urls(df, spark.createDataFrame(rules, url_filter.RULES), partitions=5).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fit)[1] if fit else None
        verdict = max((v for _, r, v in fit if r == rule), default="allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict)
    assert {r.verdict for r in url_filter.judge_urls(df, spark.createDataFrame([], url_filter.RULES)).collect()} == {"allow"}


def test_pipeline(spark, docs, labels, tmp_path):
    import corpus_pipeline as p

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("a", "one")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got, n = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (_, stage) in enumerate(p.STAGES):
        stage(spark, got, str(tmp_path)).write.parquet(str(tmp_path / f"s{i}"))
        got = spark.read.parquet(str(tmp_path / f"s{i}"))
        assert got.columns == docs.columns or i == 4
        n.append(got.count())
    assert n[0] >= n[1] >= n[2] and n[3] == n[4] > 0


def test_classifier_marks_toxic_ngrams(spark):
    """A few toxic words in a text of quality drop it; clean texts stay. The held-out third is not labelled."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        words = [f"w{x}" for x in rng.integers(0, 300, 120)]
        if i % 5 == 0:
            for at, w in zip(rng.integers(0, 120, 5), ("vile", "nasty", "scorn", "vile", "nasty"), strict=True):
                words[at] = w
        rows.append((i, " ".join(words)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(900) if i % 3], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in importance.resample(d, lab).collect()}
    clean, toxic = ([kept[i] for i in range(0, 900, 3) if (i % 5 == 0) == x] for x in (False, True))
    assert sum(clean) >= 0.98 * len(clean) and sum(toxic) <= 0.1 * len(toxic)


def test_classifier_marks_inflected_toxic_words(spark):
    """Toxic words of a common stem, hardly one of them twice, drop a text of quality; clean texts stay. The held-out third is not labelled."""
    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    word = lambda k: "".join(rng.choice(letters, k))
    vocab, rows = [word(6) for _ in range(400)], []
    for i in range(900):
        words = [vocab[x] for x in rng.integers(0, 400, 150)]
        if i % 5 == 0:
            for at in rng.choice(150, 5, replace=False):
                words[at] = "zörqu" + word(4)
        rows.append((i, " ".join(words)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(900) if i % 3], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in importance.resample(d, lab).collect()}
    clean, toxic = ([kept[i] for i in range(0, 900, 3) if (i % 5 == 0) == x] for x in (False, True))
    assert sum(clean) >= 0.98 * len(clean) and sum(toxic) <= 0.1 * len(toxic)


def test_importance_by_brute_force(spark, docs, labels):
    """Weights from counts, noise added, the k largest kept; without the noise others would be."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    buckets, good = 512, {r.doc_id for r in labels.collect() if r.quality == 1 and r.toxic == 0}
    counts = np.zeros((2, 2 * buckets))
    for i, t in rows:
        for x in importance.features(t, buckets):
            counts[0, x] += 1
            counts[1, x] += i in good
    ratios = np.zeros(2 * buckets)
    for part in (slice(0, buckets), slice(buckets, None)):
        raw, target = counts[0, part], counts[1, part]
        ratios[part] = np.log(target + 5) - np.log(raw * target.sum() / raw.sum() + 5)
    k = 20
    got = importance.resample(docs, labels, k=k, buckets=buckets)
    noise = collections.defaultdict(list)
    for r in docs.select("doc_id", "text", importance.gumbel("doc_id", "text", 10).alias("g")).collect():
        noise[r.doc_id, len(importance.features(r.text))].append(r.g)
    weights, values = [], []
    for i, t in rows:
        at = importance.features(t, buckets)
        n = len(at)
        weights.append((str(i), n, round(ratios[at].sum() / (1 + max(n - 1, 0) * 0.02), 6)))
        values.append((weights[-1][2] + noise[i, n][0], i) if n else (-math.inf, i))
    rows_got = got.collect()
    assert sorted((str(r.doc_id), r.n_features, round(r.log_weight, 6)) for r in rows_got) == sorted(weights)
    cut = sorted(values, key=lambda x: -x[0])[k - 1][0]
    want = collections.Counter(i for v, i in values if v >= cut - 1e-9)
    assert collections.Counter(r.doc_id for r in rows_got if r.kept) == want
    bare = sorted((w[2] for w in weights if w[1]), reverse=True)[k - 1]
    assert sum((w[2] >= bare and w[1] > 0) != (v >= cut - 1e-9) for w, (v, _) in zip(weights, values, strict=True)) >= 4
    noises = [g for gs in noise.values() for g in gs]
    assert 0.1 < np.mean(noises) < 1.1 and importance.resample(docs, labels, k=0).where("kept").count() == 0
    assert importance.resample(docs, labels.limit(0)).where("kept <> (n_features > 0)").count() == 0
    kept = importance.resampled_documents(docs, labels, k=k, buckets=buckets)
    assert kept.columns == docs.columns and collections.Counter(r.doc_id for r in kept.collect()) == want


def test_importance_budget_is_the_expected_number():
    x = np.array([-20.0, -19.0, 0.0, 1.0])
    a, b = importance.fit_logistic(x, np.array([0.0, 1.0, 50.0, 49.0]), np.array([40.0, 39.0, 1.0, 0.0]))
    p = 1 / (1 + np.exp(-a - b * x))
    assert b > 0 and abs((p * np.array([40, 40, 51, 49])).sum() - 100) < 2
    assert all(math.isfinite(v) for v in importance.fit_logistic(np.array([-5.0, 5.0]), np.array([0.0, 9.0]), np.array([9.0, 0.0])))


def test_importance_word_buckets_are_the_engines(spark):
    df = spark.createDataFrame([("Réeuxabc",), ("x",), ("ß€",)], "w string")
    for r in df.select("w", F.array(*quality_rules._toxic_buckets(F.col("w"), 1 << 18)).alias("b")).collect():
        assert importance.word_buckets(r.w.lower(), 1 << 18) == r.b


def test_toxic_words_are_parted_as_they_are_learnt(spark):
    ratios = importance.ToxicRatios(np.zeros(1 << 18))
    text = "a\u00a0b\u2003c d\x1ce\x85f\tg\x0bÉcole\ud7ff"
    importance.toxic_evidence(text, ratios)
    learnt = spark.createDataFrame([(text,)], "t string").select(words(F.lower("t"))).first()[0]
    assert sorted(w.decode() for w in ratios) == sorted(learnt) and len(learnt) == 4


def test_large_groups_are_cut_by_medians_only(spark):
    """40 groups of copies, each a fifth of a shard: seven splits cut at most seven of them."""
    df = spark.range(4000).selectExpr("id doc_id", "concat('text ', 100 + id % 40) text", "'s' source", "'en' lang")
    got = sharding.kd_shards(df, n_shards=8).selectExpr("doc_id % 40 g", "shard", "size").collect()
    shards, size = collections.defaultdict(set), collections.Counter()
    for r in got:
        shards[r.g].add(r.shard)
        size[r.shard] += r.size
    assert sum(len(x) - 1 for x in shards.values()) <= 7
    assert len(size) == 8 and max(size.values()) < 1.1 * min(size.values())


CLASHING = ["row_key", "dk", "n", "w", "v", "h", "r", "key", "mix_key", "mix_copy", "weighed", "tokens", "windows", "ratios", "shard", "fingerprint", "root", "hit_key", "__row", "__n", "__key", "__copy", "__weight", "t_id", "words"]


@pytest.fixture(scope="module")
def crowded(spark, docs):
    """The documents with columns named like the operators' own, all of value 'mine'."""
    return docs.select("*", *[F.lit("mine").alias(c) for c in CLASHING])


def test_clashing_columns_come_back_unchanged(spark, crowded, labels):
    bench = spark.createDataFrame([("a", "one")], "item_id string, text string")
    for kept in (importance.resampled_documents(crowded, labels), simhash.drop_near_duplicates(crowded), decontaminate.drop_contaminated(crowded, bench), mixing.mixed_documents(crowded)):
        assert kept.columns == crowded.columns
        assert kept.select(*CLASHING).distinct().collect() == [tuple(["mine"] * len(CLASHING))]


def test_clashing_columns_change_no_result(spark, docs, crowded, labels):
    bench = spark.createDataFrame([("a", "one", "mine")], "item_id string, text string, w string")
    b = bench.drop("w")
    same = lambda x, y: collections.Counter(map(repr, x.collect())) == collections.Counter(map(repr, y.collect()))
    assert same(quality_rules.quality(crowded, labels), quality_rules.quality(docs, labels))
    assert same(secrets.scan_secrets(crowded), secrets.scan_secrets(docs))
    assert same(decontaminate.contamination(crowded, bench), decontaminate.contamination(docs, b))
    assert same(mixing.mix_sources(crowded), mixing.mix_sources(docs))
    assert same(sharding.kd_shards(crowded, n_shards=1).drop("slot"), sharding.kd_shards(docs, n_shards=1).drop("slot"))


def test_empty_tables_and_texts(spark, docs, labels):
    none = docs.limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert secrets.scan_secrets(none).count() == 0 and quality_rules.quality(none, labels).count() == 0
    assert url_filter.judge_urls(pages, spark.createDataFrame([("org", "", "block")], url_filter.RULES)).count() == 0
    assert importance.resampled_documents(none, labels).count() == 0 and mixing.mixed_documents(none).count() == 0
    assert simhash.drop_near_duplicates(none).count() == 0
    assert decontaminate.drop_contaminated(none, spark.createDataFrame([], "item_id string, text string")).count() == 0


def test_rules_without_a_path(spark):
    df = spark.createDataFrame([(1, "https://a.org"), (2, "https://b.org/x"), (3, "https://org.com"), (4, None)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(df, spark.createDataFrame([("org", "", "block")], url_filter.RULES)).collect()}
    assert got == {1: ("org", "block"), 2: ("org", "block"), 3: (None, "allow"), 4: (None, "allow")}


def test_quality_ratio_by_brute_force(spark, docs, rows, labels):
    """The score from counted words and pairs, over the same hash buckets."""
    buckets = 64
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.toxic == 0}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    digest = lambda w, seed=42: xxhash.xxh64_intdigest(w.encode(), seed)

    def grams(t):
        w = WORD.findall(t or "")
        return [signed(digest(x)) % buckets for x in w], [buckets + signed(digest(y, digest(x)) if y is not None else digest(x)) % buckets for x, y in zip(w, [*w[1:], None])]

    counts = np.zeros((2, 2 * buckets))
    for i, t in rows:
        for x in sum(grams(t), []):
            counts[:, x] += 1, i in good
    ratio = np.zeros(2 * buckets)
    for part in (slice(0, buckets), slice(buckets, None)):
        raw, target = counts[0, part], counts[1, part]
        ratio[part] = np.log(target + 5) - np.log(raw * target.sum() / raw.sum() + 5)
    want = sorted((str(i), round(float(np.mean(ratio[sum(grams(t), [])])), 6) if WORD.findall(t or "") else 0.0) for i, t in rows)
    got = quality_rules.quality(docs, labels, buckets=buckets, threshold=-0.01).collect()
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == want
    assert all(r.kept == (not r.base_failed and r.score >= -0.01 and r.toxic_score <= 5) for r in got)


def test_quality_drops_toxic_documents(spark):
    """A few toxic words in a text of quality drop it, copies of one toxic text mark nothing else; the held-out third is not labelled."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        words = [f"w{x}" for x in rng.integers(0, 300, 120)]
        if i % 5 == 0:
            for at in rng.integers(0, 120, 5):
                words[at] = rng.choice(["vile", "Nasty", "scorn"])
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, "seldom found in " + " ".join(f"w{x}" for x in range(100)) + " vile " * 3) for i in range(100)] + [(2000, "seldom found in " + " ".join(f"w{x}" for x in range(60)))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1, int(i % 5 == 0 or i >= 1000)) for i, _ in rows if i % 3 and i < 2000], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.quality(d, lab).collect()}
    clean, toxic = ([got[i].kept for i in range(0, 900, 3) if (i % 5 == 0) == x] for x in (False, True))
    assert sum(clean) >= 0.98 * len(clean) and sum(toxic) <= 0.1 * len(toxic) and got[2000].toxic_score <= 0 < got[1001].toxic_score


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from factlake.llm import common

    class Away:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        common.shared_dir(Away)
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_pipeline_run_leaves_only_the_last_stages_tables(spark, docs, labels, tmp_path):
    import corpus_pipeline as p
    from factlake.llm import common

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("a", "one")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    before = common.live()
    got = p.run(spark, str(tmp_path)).collect()
    left = [x for x in common.live() if x not in before]
    assert got and not any(f"stage{i}-" in x for x in left for i in range(3)) and any("stage3-" in x for x in left)
    names = got[0].asDict().keys()
    assert list(names) == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert {r.shard for r in got} <= set(range(8))
