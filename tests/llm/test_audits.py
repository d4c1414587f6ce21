"""Filter audit, Merkle manifest and license scan against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from factlake.llm import licenses
from factlake.llm.filter_audit import audit_filters, failure_cells
from factlake.llm.license_templates import TEMPLATES
from factlake.llm.manifest import fold, manifest, proof
from factlake.llm.queries import FILTERS, op13_licenses

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx int, n int, g string, part string, digest string, path string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    long = " ".join(r.choices("ab cd ef gh Ij kl".split(), k=150))
    distinct = " ".join(f"w{i}" for i in range(260))
    texts = [long, long + " " + distinct, distinct, "LOUD " * 300, "x $ y", "", None, " \t\n", "É" * 40, distinct + " 50% off", distinct.upper()]
    out = [(i, r.choice(texts), r.choice(["en", "en", "en", "de", None]), r.choice(["a", "b", "", None]), r.choice([i, None])) for i in range(230)]
    out += [(1000, "alone", "lone", "c", 1), (None, distinct, "en", "a", None), (None, distinct, "en", "a", None), (7, distinct, "en", "b", 1), (7, distinct, "en", "b", 1), (None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "g", "p", "d", "x") for r in rows], SCHEMA).repartition(5)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])


def tree(leaves):
    """root and, per leaf, [(left, right)] from the bottom."""
    paths, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run = place // 8 * 8
            paths[i].append(("".join(nodes[run:place]), "".join(nodes[place + 1 : run + 8])))
            at[i] = place // 8
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def test_manifest_by_brute_force(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        tampered = r[1] and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        found = re.sub("[A-Z]", lambda m: m[0].lower(), r[1]) if tampered else r[1]
        groups[r[2]].append((r[0], leaf_of(r, r[1]), leaf_of(r, found)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {g: tree([x[1] for x in groups[g]]) for g in order}
    root, tops = tree([trees[g][0] for g in order])
    want = []
    for g, top in zip(order, tops, strict=True):
        for (doc_id, leaf, found), path in zip(groups[g], trees[g][1], strict=True):
            at = found
            for left, right in path + top:
                at = h(left, at, right)
            want.append((doc_id, leaf, trees[g][0], root, h(*[a + b for a, b in path + top]), at, at == root))
    changed = {"text": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))}
    got = manifest(docs, "doc_id", "lang", ["doc_id", "source", "lang", "n_chars", "text"], changed).select("id", "leaf", "subroot", "root", proof(F.col("path")), fold(F.col("path"), F.col("found")), fold(F.col("path"), F.col("found")) == F.col("root"))
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert any(not w[-1] for w in want)


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest_of_other_arity_finds_every_change(docs, arity):
    out = manifest(docs, "doc_id", "lang", ["doc_id", "text"], {"text": F.when(F.col("doc_id") == 5, "changed").otherwise(F.col("text"))}, arity)
    assert {r.id for r in out.where(fold(F.col("path"), F.col("found")) != F.col("root")).collect()} == {5}
    assert out.select("root").distinct().count() == 1 and out.select("subroot").distinct().count() == 4


def test_manifest_of_an_empty_table_and_one_row(spark, docs):
    columns = ["doc_id", "text"]
    assert manifest(docs.limit(0), "doc_id", "lang", columns).count() == 0
    (r,) = manifest(docs.where("doc_id = 1000"), "doc_id", "lang", columns).collect()
    assert r.leaf == r.subroot == r.root and r.path == []


def fails(rows):
    smallest = {}
    for r in rows:
        t = r[1] or ""
        if r[0] is not None and r[0] < smallest.get(t, r[0] + 1):
            smallest[t] = r[0]
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        yield r, {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": r[0] is not None and r[0] > smallest[t]}


def test_filter_audit_by_brute_force(spark, docs, rows):
    said = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(0, 200)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1), (5, None, None)]
    labels = spark.createDataFrame(said, "doc_id long, quality int, toxic int")
    good, toxic = {d for d, q, _ in said if q == 1 and d is not None}, {d for d, _, t in said if t == 1 and d is not None}
    want, total = Counter(), Counter()
    for r, f in fails(rows):
        part = r[3] or ""
        for order in itertools.permutations(FILTERS):
            gone = False
            for step, own in enumerate(order, 1):
                key = (part, "".join(order), step)
                want[key, "kept"] += not gone and not f[own]
                want[key, "removed"] += not gone and f[own]
                want[key, "redundant"] += gone and f[own]
                want[key, "unique_fails"] += f[own] and sum(f.values()) == 1
                want[key, "good_lost"] += not gone and f[own] and r[0] in good
                want[key, "toxic_lost"] += not gone and f[own] and r[0] in toxic
                total[part, own] += not gone and f[own]
                gone |= f[own]
    got = audit_filters(failure_cells(docs, labels), FILTERS).collect()
    assert len(got) == 120 * 5 * len({r[3] or "" for r in rows})
    for g in got:
        for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert g[c] == want[(g.part, g.filter_order, g.step), c], (g, c)
        assert g.shapley == total[g.part, g.filter_order[g.step - 1]]
    assert all(any(g[c] for g in got) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))


def test_filter_audit_of_empty_tables(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(failure_cells(docs.limit(0), labels), FILTERS).count() == 0
    assert {(r.good_lost, r.toxic_lost) for r in audit_filters(failure_cells(docs, labels), FILTERS).collect()} == {(0, 0)}


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def pattern(items):
    out = ""
    for x in items:
        out += x.decode() + " " if isinstance(x, bytes) else f"(?:{pattern(x[1])})?" if x[0] == "optional" else f"(?:(?:{'[^ ]+' if x[3] == '.+' else x[3]}) ){{{x[1]},{x[2]}}}"
    return out


def filled(items, r, holder):
    """A text that the template describes."""
    out = []
    for x in items:
        if isinstance(x, bytes):
            out.append(x.decode())
        elif x[0] == "optional":
            out += filled(x[1], r, holder) if r.random() < 0.5 else []
        else:
            n = r.randint(x[1], x[2])
            out += [x[3].split("|")[0].replace("[0-9]+", "2").replace(".+", "") or holder for _ in range(n)]
    return out


def test_licenses_by_brute_force(spark, tmp_path):
    r, texts = random.Random(2), [None, "", " .,;", "mit license mit license", "CC BY cc by-nc 4.0 ", "the GNU\ngeneral (public) LICENSE", "Licence Apache license" + " é" * 3000]
    for given in TEMPLATES.values():
        for template in given:
            words = filled(licenses.parse(template), r, "Acmé")
            texts.append("Intro; " + ", ".join(words) + " . And more.")
            texts.append(" ".join(w.upper() for w in words))
            cut = r.randrange(len(words))
            texts.append(" ".join(words[:cut] + ["zzz"] + words[cut + 1 :]))
            texts.append(" ".join(words[: len(words) // 2] + words))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "mit license", "x"), (0, None, "x")], "doc_id long, text string, n_words string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    n_accepted = 0
    for row in op13_licenses(spark, str(tmp_path)).collect():
        text = "mit license" if row.doc_id is None else texts[row.doc_id]
        words = tokens(text)
        joined = "".join(f" {w}" for w in words) + " "
        base = [(label, i, len(p.split())) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        longest, found = max((n for *_, n in base), default=0), set()
        for label, given in TEMPLATES.items():
            for template in given:
                items = licenses.parse(template)
                while licenses.may_be_empty(items[0]):
                    items = items[1:]
                if re.search(" " + pattern(items), joined):
                    found.add(label)
                    longest = max(longest, len(licenses.mandatory(items)))
        n_accepted += bool(found)
        starts = [i for _, i, _ in base]
        assert (row.n_words, row.n_base, row.first_word, row.last_word) == (len(words), len(base), min(starts, default=None), max(starts, default=None))
        assert row.base_labels == ",".join(sorted({b[0] for b in base})) and row.labels == ",".join(sorted({b[0] for b in base} | found)), text
        assert row.score == pytest.approx(longest / len(words) if words else 0)
    assert n_accepted > 40


def test_license_wording_must_match_exactly():
    mit = licenses.compiled("mit", TEMPLATES["mit"][0])
    text = TEMPLATES["mit"][0]
    words = filled(licenses.parse(text), random.Random(1), "holder")
    at = words.index("permission")
    assert mit.end_of([w.encode() for w in words], at) == len(words)
    for i in range(at, len(words)):
        if words[i] != "holder" and words[i] not in ("including", "the", "next", "paragraph"):
            wrong = [*words[:i], "zzz", *words[i + 1 :]]
            assert mit.end_of([w.encode() for w in wrong], at) is None, words[i]


@pytest.mark.parametrize("template", ["", "<<beginOptional>>a<<endOptional>>", "<<var;words=\"1-2\">> a", "a <<endOptional>>", "a <<beginOptional>> b"])
def test_wrong_templates_are_errors(template):
    with pytest.raises(ValueError):
        licenses.compiled("x", template)


def test_license_scan_is_linear_in_a_text():
    found = licenses.automata(TEMPLATES)
    text = b"permission is hereby granted " * 40_000
    assert licenses.scan(text, {}, found) == (160_000, [], [], 0.0)
