"""Secret scan: fixed patterns plus character Markov models, by DataFrame operations only.

Two order-1 models over characters are compared on every token: a run of letters and digits, so
that a key is judged by itself in a path, after a name or between separators; what a pattern's
match covers of a run is cut out, and every part that is left, between two matches too, is judged. The random model learns
from labelled secrets (the values that the fixed patterns find), the ordinary one from the other
tokens that look like identifiers (no digits enclosed by letters); each distinct token counts once,
so copies carry no weight. A token whose log-likelihood ratio, random to ordinary, reaches NEEDED in
all and THRESHOLD per character is reported as kind markov: short tokens must be the more telling.
The models are two tables of fixed size (one entry per pair of ASCII characters), handed to the
tasks as a scalar subquery.

Spans are code points, end exclusive. Defined results: a null or empty text has no spans;
repeated rows are scanned alike; without labelled secrets the random model is uniform; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain, text_of, written

# The base patterns, in the order in which ties are listed.
ASSIGN = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "(AKIA[A-Z0-9]+)"
HEX = "([0-9a-f]+)"
#: kind: pattern, pattern that a text with a span must hold, least length, and whether the length is that of the value.
BASE = {"assign": (ASSIGN, ASSIGN, 6), "access": (ACCESS, "AKIA[A-Z0-9]{16}", 20), "hex": (HEX, "[0-9a-f]{24}", 24)}
KINDS = ["assign", "access", "hex", "markov"]

#: Tokens that the Markov models judge and learn from: this long at least.
MIN_TOKEN = 12
TOKEN = f"([A-Za-z0-9]{{{MIN_TOKEN},}})"
#: Log-likelihood ratio from which a token is a secret, and that per character.
NEEDED, THRESHOLD = 10.0, 0.5
#: Other long tokens with this are neither labelled as secrets nor as ordinary.
_UNCLEAR = "[A-Za-z][0-9]+[A-Za-z]"
_ALPHABET = 66
#: Share of evenly distributed characters in the random model.
UNIFORM = 0.5
#: Pseudo-count with which pairs of characters lean on single ones.
_BACK = 10.0
_CODES = 128
#: Values that are summed in one array before the sums of such arrays are.
_CHUNK = 256
_SPANS = "array<struct<start:int,end:int,value:string>>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is evaluated once however often then names it."""
    return F.get(F.transform(F.array(value), then), 0)


def _running(values: Column) -> Column:
    """Running sums of an array of longs, in chunks, so that the work grows with its length (an array that grows in an aggregate is copied each time)."""
    zero = F.lit(0).cast("long")
    sums = lambda chunk: F.aggregate(chunk, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"] + x).alias("out")), lambda a: a["out"])
    chunks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _CHUNK).cast("int")), lambda i: sums(F.slice(v, i * _CHUNK + 1, _CHUNK)))
    ends = lambda c: F.transform(c, lambda x: F.element_at(x, -1))
    added = lambda c: F.flatten(F.zip_with(c, F.slice(F.concat(F.array(zero), sums(ends(c))), F.lit(1), F.size(c)), lambda x, before: F.transform(x, lambda v: v + before)))
    return _let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<bigint>")).otherwise(_let(chunks(v), added)))


def _matches(text: Column, pattern: str, must: str, least: int, part: bool) -> Column:
    """start, end and value of the pattern's matches whose value (the whole match, or its group) has at least so many characters."""
    long = lambda array: F.transform(array, lambda p: F.char_length(p).cast("long"))
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(whole: Column) -> Column:
        ends = _running(F.zip_with(F.slice(long(gaps), 1, F.size(whole)), long(whole), lambda gap, n: gap + n))
        values = F.transform(whole, lambda m: F.regexp_extract(m, pattern, 1)) if part else whole
        spans = F.transform(F.arrays_zip(ends.alias("end"), whole.alias("whole"), values.alias("value")), lambda z: F.struct((z["end"] - F.char_length(z["whole"])).cast("int").alias("start"), z["end"].cast("int").alias("end"), z["value"].alias("value")))
        return F.filter(spans, lambda s: F.char_length(s["value"]) >= least)

    return F.when(text.rlike(must), _let(whole, placed)).otherwise(F.array().cast(_SPANS))


def _outside(runs: Column, base: Column) -> Column:
    """The parts of runs (start, end, value, apart and in order) that no base span covers.

    Ends of runs and spans are sorted together; running sums tell at each of them how many of either are open, and
    what lies between two is a part if a run is open and no span.
    """

    def ends(of: Column, end: str, run: int, span: int) -> Column:
        return F.transform(of, lambda s: F.struct(s[end].cast("long").alias("at"), F.lit(run + (span << 20)).cast("long").alias("open"), F.lit(max(run, 0)).cast("long").alias("nth")))

    events = F.array_sort(F.concat(ends(runs, "start", 1, 0), ends(runs, "end", -1, 0), ends(base, "start", 0, 1), ends(base, "end", 0, -1)))

    def parts(e: Column) -> Column:
        column = lambda name: F.transform(e, lambda x: x[name])
        after = F.slice(column("at"), 2, F.size(e))
        zipped = F.arrays_zip(F.slice(column("at"), 1, F.size(e) - 1).alias("start"), after.alias("end"), _running(column("open")).alias("open"), _running(column("nth")).alias("nth"))
        inside = F.filter(zipped, lambda z: (z["open"] == 1) & (z["end"] - z["start"] >= MIN_TOKEN))
        run = lambda z: F.element_at(runs, z["nth"].cast("int"))
        return F.transform(inside, lambda z: F.struct(z["start"].cast("int").alias("start"), z["end"].cast("int").alias("end"), F.substr(run(z)["value"], (z["start"] - run(z)["start"] + 1).cast("int"), (z["end"] - z["start"]).cast("int")).alias("value")))

    return F.when((F.size(runs) == 0) | (F.size(base) == 0), runs).otherwise(_let(events, parts))


def with_base_spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with base: start, end, value and kind of every base span, and tokens: what lies outside them of the runs."""
    found = docs.withColumns({k: _matches(F.col("text"), *BASE[k], part=k == "assign") for k in BASE} | {"long": _matches(F.col("text"), TOKEN, TOKEN, MIN_TOKEN, part=False)})
    spans = F.concat(*[F.transform(k, lambda s: F.struct(s["start"], s["end"], F.lit(i).alias("kind"), s["value"])) for i, k in enumerate(BASE)])
    return found.withColumn("base", spans).withColumn("tokens", _outside(F.col("long"), F.col("base"))).drop("long", *BASE)


def _steps(value: Column) -> Column:
    """Numbers of a value's character pairs; the first follows code 0."""
    codes = F.transform(F.split(value, ""), lambda c: F.least(F.ascii(c), F.lit(_CODES - 1)))
    return F.zip_with(F.concat(F.array(F.lit(0)), F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0)))), codes, lambda a, b: a * _CODES + b)


def markov_model(found: DataFrame) -> DataFrame:
    """One row, ratios: the log ratio, random to ordinary, per pair of characters."""
    labelled = found.select(F.explode(F.concat(F.transform("base", lambda s: F.struct(s["value"].alias("value"), F.lit(1).alias("random"))), F.transform("tokens", lambda t: F.struct(t["value"].alias("value"), F.lit(0).alias("random"))))).alias("x")).select("x.value", "x.random")
    distinct = labelled.where((F.col("value") != "") & ((F.col("random") == 1) | ~F.col("value").rlike(_UNCLEAR))).groupBy("value", "random").agg(F.lit(1).alias("one"))
    # ordinary words may be written in capitals throughout
    written_so = distinct.select("random", F.explode(F.when(F.col("random") == 1, F.array("value")).otherwise(F.array("value", F.upper("value")))).alias("value"))
    steps = written_so.select("random", F.explode(_steps(F.col("value"))).alias("step"))
    counts = steps.groupBy("step").agg(F.sum("random").alias("r"), F.sum(1 - F.col("random")).alias("o"))
    # at most _CODES * _CODES rows, here and below
    ids = found.sparkSession.range(_CODES * _CODES).select(F.col("id").cast("int").alias("step"), (F.col("id") / _CODES).cast("int").alias("prev"), (F.col("id") % _CODES).cast("int").alias("cur"))
    every = ids.join(F.broadcast(counts), "step", "left").fillna(0, ["r", "o"])
    before = every.groupBy("prev").agg(F.sum("r").alias("r_prev"), F.sum("o").alias("o_prev"))
    single = every.groupBy("cur").agg(F.sum("r").alias("r_cur"), F.sum("o").alias("o_cur"))
    total = every.groupBy().agg(F.sum("r").alias("r_all"), F.sum("o").alias("o_all")).select(F.array("r_all", "o_all").alias("all")).scalar()
    joined = every.join(F.broadcast(before), "prev").join(F.broadcast(single), "cur").withColumn("all", total)
    p = {}
    for i, x in enumerate("ro"):  # pairs lean on single characters, those on equal shares
        alone = (F.col(f"{x}_cur") + 0.5) / (F.col("all")[i] + 0.5 * _ALPHABET)
        p[x] = (F.col(x) + _BACK * alone) / (F.col(f"{x}_prev") + _BACK)
    # labelled secrets may be of one kind; any random string is half the model
    p["r"] = (1 - UNIFORM) * p["r"] + UNIFORM / _ALPHABET
    return joined.agg(F.transform(F.sort_array(F.collect_list(F.struct("step", (F.log(p["r"]) - F.log(p["o"])).alias("lr")))), lambda x: x["lr"]).alias("ratios"))


def scan_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, needed: float = NEEDED) -> DataFrame:
    """A row per document: doc_id, spans (array of start, end, kind number), values (the matched texts, in that order)."""
    docs = documents.select(plain(id_col).alias("doc_id"), text_of(plain(text_col)).alias("text"))
    # texts are read once; the model and the verdict read what was found
    found = written(with_base_spans(docs).drop("text"), "spans")
    judged = found.withColumn("ratios", markov_model(found).scalar())
    score = lambda t: F.aggregate(_steps(t["value"]), F.lit(0.0), lambda a, s: a + F.element_at(F.col("ratios"), s + 1))
    scored = F.transform("tokens", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["value"].alias("value"), score(t).alias("score")))
    added = F.transform(F.filter(scored, lambda t: (t["score"] >= needed) & (t["score"] >= threshold * F.char_length(t["value"]))), lambda t: F.struct(t["start"], t["end"], F.lit(len(BASE)).alias("kind"), t["value"]))
    ordered = F.sort_array(F.transform(F.concat("base", added), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))))
    return judged.select("doc_id", ordered.alias("spans"))


def span_digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
