"""License scan: fixed phrases, and templates whose optional and replaceable regions are compiled into token automata.

A template is license wording with markup (license_templates.py). It becomes an automaton over words:
a state for each mandatory word, a way around each optional region, and a counted state for
each replaceable one. A text is accepted where the automaton runs from its first mandatory words to its
end, so the mandatory wording must match word by word, in order, while white space, punctuation, ASCII
case and what stands in replaceable regions do not matter.

Every template has a mandatory run of words that all its matches begin with (leading regions that
may be empty decide nothing and are left off), so an automaton is started only where that run
stands, and none is lost. Each document is read once, by itself; nothing is shuffled.

Defined results: a null or empty text has no words, no labels and score zero; repeated rows are scanned
alike; ties do not arise; of long texts nothing is cut; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import plain
from .license_templates import TEMPLATES

# Phrase and its label.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: What parts words, as spaces; A to Z as a to z.
_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_MARK = re.compile(r"<<(beginOptional|endOptional|var)((?:;\w+=\"[^\"]*\")*)>>")


def words_of(text: bytes) -> list[bytes]:
    """Words of UTF-8 text: runs of ASCII letters, digits and characters outside ASCII, lower-cased in ASCII."""
    return text.translate(_BYTES).split()


def parse(template: str) -> list:
    """Items of a template: a word (bytes), ('optional', items) or ('var', least, most, pattern of its words)."""
    stack, at = [[]], 0
    for m in _MARK.finditer(template):
        stack[-1] += words_of(template[at : m.start()].encode())
        at = m.end()
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional":
            if len(stack) == 1:
                raise ValueError("endOptional without beginOptional")
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        else:
            given = dict(re.findall(r";(\w+)=\"([^\"]*)\"", m[2]))
            least, _, most = given.get("words", "0-1").partition("-")
            stack[-1].append(("var", int(least), int(most or least), given.get("match", ".+")))
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0] + words_of(template[at:].encode())


def mandatory(items: list) -> list[bytes]:
    return [x for x in items if isinstance(x, bytes)]


def may_be_empty(item) -> bool:
    return not isinstance(item, bytes) and (item[0] == "optional" or item[1] == 0)


@dataclass
class Automaton:
    """States 0 to n; a state's ways are (word or pattern, next state). The last state accepts."""

    label: str
    start: bytes  # the words that every match begins with, spaces around them
    n_mandatory: int
    ways: list[list[tuple[bytes | re.Pattern, int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)  # ways that take no word

    def reach(self, states: set[int]) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def end_of(self, words: list[bytes], at: int) -> int | None:
        """Where the shortest match that begins at word `at` ends (exclusive), if one does."""
        states, last = self.reach({0}), len(self.ways) - 1
        while last not in states:
            if at == len(words):
                return None
            word = words[at]
            states = self.reach({to for s in states for what, to in self.ways[s] if (what == word if isinstance(what, bytes) else what.fullmatch(word))})
            if not states:
                return None
            at += 1
        return at


def compiled(label: str, template: str) -> Automaton:
    """The automaton of a template; it must hold a mandatory word before any region that takes words."""
    items = parse(template)
    while items and may_be_empty(items[0]):
        items = items[1:]
    run = []
    for x in items:
        if not isinstance(x, bytes):
            break
        run.append(x)
    if not run:
        raise ValueError(f"a template of {label} has no mandatory word to begin with")
    out = Automaton(label, b" " + b" ".join(run) + b" ", len(mandatory(items)), [[]], [[]])

    def state() -> int:
        out.ways.append([])
        out.free.append([])
        return len(out.ways) - 1

    def add(items: list, at: int) -> int:
        for x in items:
            if isinstance(x, bytes):
                to = state()
                out.ways[at].append((x, to))
            elif x[0] == "optional":
                end, to = add(x[1], at), state()
                out.free[end].append(to)
                out.free[at].append(to)
            else:
                _, least, most, pattern = x
                matches, skips = re.compile(pattern.encode()), []
                for i in range(most):
                    skips += [at] * (i >= least)
                    to = state()
                    out.ways[at].append((matches, to))
                    at = to
                to = state()
                for s in [*skips, at]:
                    out.free[s].append(to)
            at = to
        return at

    add(items, 0)
    return out


def automata(templates: dict[str, list[str]]) -> list[Automaton]:
    return [compiled(label, t) for label, given in templates.items() for t in given]


def _places(joined: bytes, phrase: bytes) -> Iterator[int]:
    """Numbers of the words at which the phrase stands; joined and phrase have a space around every word."""
    at, word, counted = joined.find(phrase), 0, 0
    while at >= 0:
        word += joined.count(b" ", counted, at)
        counted = at
        yield word
        at = joined.find(phrase, at + 1)


def scan(text: bytes, phrases: dict[bytes, str], found: list[Automaton]) -> tuple[int, list[tuple[str, int, int]], list[tuple[str, int, int]], float]:
    """Number of words; places of phrases and of templates (label, first word, end); score.

    The score is the share of the text's words that the longest phrase or template found has to have.
    """
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    base = [(label, at, at + phrase.count(b" ") - 1) for phrase, label in phrases.items() for at in _places(joined, phrase)]
    longest, places = max((end - at for _, at, end in base), default=0), []
    for a in found:
        done = 0
        for at in _places(joined, a.start):
            if at >= done and (end := a.end_of(words, at)) is not None:
                places.append((a.label, at, end))
                longest, done = max(longest, a.n_mandatory), end
    return len(words), base, places, longest / len(words) if words else 0.0


_SPAN = "struct<label:string,start:int,end:int>"


def scan_licenses(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """A row per document: doc_id, n_words, base (places of phrases), found (places of templates), score. Places: label, start, end in words."""
    kind = dict(documents.dtypes)[id_col]
    automata(templates)  # a wrong template is an error here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, fixed = automata(templates), {b" " + p.encode() + b" ": label for p, label in phrases.items()}
        place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            n_words, base, found, scores = [], [], [], []
            for text in batch.column(1):
                n, b, f, score = scan(text.as_py() or b"", fixed, known)
                n_words.append(n)
                scores.append(score)
                for out, spans in ((base, b), (found, f)):
                    out.append([{"label": x, "start": s, "end": e} for x, s, e in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(base, place), pa.array(found, place), pa.array(scores, pa.float64())], names=["doc_id", "n_words", "base", "found", "score"])

    rows = documents.select(plain(id_col).alias("doc_id"), plain(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, base array<{_SPAN}>, found array<{_SPAN}>, score double")
