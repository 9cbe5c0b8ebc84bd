"""Secret scans: fixed formats, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import stored


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(["password", "passwd", "secret", "token", "api_?key"])
# The scanned formats in their order of precedence, and the least length of a hit.
ASSIGN = ("(" + "|".join(_either(w) for w in _NAMES.split("|")) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
BASE = (("assign", ASSIGN), ("access", "AKIA[A-Z0-9]{16,}"), ("hex", "[0-9a-f]{24,}"))
MARKOV = "markov"
MARK = "[SECRET]"
# Tokens that the Markov models judge, and their alphabet; other characters end a token.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
# Sampled documents (expected number) that give ordinary identifiers, and base hits that give random strings.
SAMPLE_DOCS, SAMPLE_HITS = 500, 2000
# The share of ordinary identifiers that must score below the threshold.
ORDINARY = 0.999
# Matches whose lengths are summed together, and code points of a text that are redacted together.
BLOCK, CHUNK = 32, 1024

SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, also where ``use`` refers to it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(steps: Column, use: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``use(upto)``, where ``upto(i)`` is the sum of the first ``i`` of ``steps``.

    Sums are kept per ``BLOCK`` steps and per ``BLOCK`` such blocks, so that a sum adds at most about
    ``2 * BLOCK + n / BLOCK**2`` numbers.
    """
    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, z: a + z)

    def blocks(part: Column) -> Column:
        every = F.sequence(F.lit(0), F.floor((F.size(part) - 1) / BLOCK).cast("int"))
        return F.transform(every, lambda b: total(F.slice(part, b * BLOCK + 1, F.lit(BLOCK))))

    def whole(i: Column, width: int) -> Column:
        return F.floor(i / width).cast("int")

    def upto(one: Column, many: Column, most: Column) -> Callable[[Column], Column]:
        return lambda i: (total(F.slice(most, F.lit(1), whole(i, BLOCK * BLOCK)))
                          + total(F.slice(many, whole(i, BLOCK * BLOCK) * BLOCK + 1, whole(i, BLOCK) % BLOCK))
                          + total(F.slice(one, whole(i, BLOCK) * BLOCK + 1, i % BLOCK)))

    return bound(steps, lambda one: bound(blocks(one), lambda many: bound(blocks(many), lambda most: use(upto(one, many, most)))))


def spans_of(text: Column, pattern: str, kind: str, rank: int) -> Column:
    """All leftmost non-overlapping matches as ``start, rank, end, kind``, in code points.

    The text between matches and the matches alternate, so an end is the sum of their lengths up to it.
    """
    found = matches(text, pattern)
    between = F.split(text, pattern, -1)
    pairs = F.transform(F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.size(found)).alias("b")),
                        lambda z: F.struct((F.length(z["b"]) + F.length(z["m"])).alias("step"), F.length(z["m"]).alias("n")))
    some = bound(pairs, lambda all_: running(F.transform(all_, lambda z: z["step"]), lambda upto: F.transform(
        all_, lambda z, i: _span(z, upto(i + 1), kind, rank))))
    return F.when(text.rlike(pattern), some).otherwise(F.array().cast(SPAN))


def _span(z: Column, end: Column, kind: str, rank: int) -> Column:
    return F.struct((end - z["n"]).cast("int").alias("start"), F.lit(rank).alias("rank"), end.cast("int").alias("end"), F.lit(kind).alias("kind"))


def base_spans(text: Column) -> Column:
    """Spans of the fixed formats, in order; an assignment counts if its value has 6 or more characters."""
    out = []
    for rank, (kind, pattern) in enumerate(BASE):
        spans = spans_of(text, pattern, kind, rank)
        if kind == "assign":
            values = F.when(text.rlike(pattern), matches(text, pattern, 2)).otherwise(F.array().cast("array<string>"))
            both = F.arrays_zip(spans.alias("s"), values.alias("v"))
            spans = F.transform(F.filter(both, lambda z: F.length(z["v"]) >= 6), lambda z: z["s"])
        out.append(spans)
    return F.array_sort(F.concat(*out))


def chunks_of(text: Column) -> Column:
    return matches(text, "(?s).{1,%d}" % CHUNK)


def _taken(chunks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text in chunks, read from those that hold them."""
    first = F.floor(start / CHUNK).cast("int")
    whole = F.array_join(F.slice(chunks, first + 1, F.floor(end / CHUNK).cast("int") - first + 1), "")
    return F.substring(whole, start - first * CHUNK + 1, end - start)


def _hash_share(key: Column, wanted: int, n: int) -> Column:
    return (F.pmod(F.xxhash64(key), F.lit(1 << 30)) + 0.5) / float(1 << 30) < wanted / max(n, 1)


def _bigrams(tokens: DataFrame) -> DataFrame:
    pairs = F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring(F.col("token"), i, F.lit(2)))
    return tokens.where(F.length("token") > 1).select(F.col("ordinary"), F.explode(pairs).alias("pair")).groupBy("ordinary", "pair").count()


def _score(token: Column, ratios: Column) -> Column:
    """Log-likelihood ratio of a token: random string against identifier, summed over its transitions."""
    size = len(ALPHABET)
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return bound(codes, lambda code: F.aggregate(
        F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0),
        lambda a, i: a + F.element_at(ratios, F.element_at(code, i) * size + F.element_at(code, i + 1) + 1)))


def learn(found: DataFrame, key: str) -> tuple[str, float]:
    """Transition log ratios (a JSON array) and the threshold, from labelled samples of ``found`` (text, base).

    Random strings are the values of a sample of base hits, and strings of digests of ids in base 64, which stand in
    where a corpus has no hits. Ordinary identifiers are words of sampled documents outside base spans, alone and
    joined with the word before by ``_`` or nothing. Half of either fits the models (add-half smoothing); the
    threshold is the ``ORDINARY`` quantile of the scores of the other ordinary half, 0 at least.
    """
    n = found.count()
    text = F.col("text")
    hit = bound(chunks_of(text), lambda chunks: F.transform("base", lambda s: _taken(chunks, s["start"], s["end"])))
    hits = stored(found.where(F.size("base") > 0).select(key, F.explode(hit).alias("hit")), "secret-hits")
    values = hits.where(_hash_share(F.xxhash64(key, "hit"), SAMPLE_HITS, hits.count())).select(
        F.regexp_extract("hit", r"([A-Za-z0-9+/_=-]{16,})$", 1).alias("token"))
    docs = stored(found.where(_hash_share(F.col(key), SAMPLE_DOCS, n)), "secret-docs")
    digests = docs.select(F.explode(F.array(*[F.translate(F.base64(F.unhex(F.sha2(F.concat_ws(":", F.lit(i), F.col(key).cast("string")), 256))), "\r\n", "") for i in range(2)])).alias("token"))
    words = docs.where(F.size("base") == 0).select(F.transform(
        matches(text, "[A-Za-z]+"), lambda w: F.substring(w, 1, 40)).alias("w"))
    joined = F.transform(F.col("w"), lambda w, i: F.concat(
        F.when(i > 0, F.element_at("w", F.greatest(i, F.lit(1)))).otherwise(""), F.when(i % 2 == 0, F.lit("_")).otherwise(F.lit("")), w))
    names = words.select(F.explode(F.concat(F.col("w"), joined)).alias("token"))
    tokens = values.union(digests).select("token", F.lit(False).alias("ordinary")).union(
        names.select("token", F.lit(True).alias("ordinary"))).where(F.length("token") > 1).distinct()
    tokens = stored(tokens.withColumn("fit", F.pmod(F.xxhash64("token"), F.lit(2)) == 0), "secret-samples")
    counts = {(r["ordinary"], r["pair"]): r["count"] for r in _bigrams(tokens.where("fit")).collect()}
    size = len(ALPHABET)
    ratios = []
    for a in ALPHABET:
        sums = [sum(counts.get((kind, a + b), 0) for b in ALPHABET) + 0.5 * size for kind in (False, True)]
        for b in ALPHABET:
            rand, plain = ((counts.get((kind, a + b), 0) + 0.5) / sums[kind] for kind in (False, True))
            ratios.append(math.log(rand / plain))
    coded = json.dumps([round(x, 5) for x in ratios])
    other = tokens.where(~F.col("fit") & F.col("ordinary"))
    score = _score(F.col("token"), F.from_json(F.lit(coded), "array<double>"))
    top = other.select(F.percentile(score, F.lit(ORDINARY)).alias("top")).first()["top"]
    return coded, max(0.0, top or 0.0)


def _before(sorted_: Column, x: Column, or_at: bool = False) -> Column:
    """How many of ``sorted_`` lie before ``x`` (with ``or_at``: or at it), by halving."""
    def step(lo: Column, hi: Column) -> Column:
        middle = F.floor((lo + hi) / 2).cast("int")
        value = F.element_at(sorted_, F.greatest(middle, F.lit(0)) + 1)
        less = value <= x if or_at else value < x
        open_ = lo < hi
        return F.struct(F.when(open_ & less, middle + 1).otherwise(lo).alias("lo"), F.when(open_ & ~less, middle).otherwise(hi).alias("hi"))

    halvings = F.sequence(F.lit(0), F.ceil(F.log2(F.size(sorted_) + F.lit(1.0))).cast("int"))
    ends = F.struct(F.lit(0).alias("lo"), F.size(sorted_).alias("hi"))
    return F.when(F.size(sorted_) == 0, F.lit(0)).otherwise(F.aggregate(halvings, ends, lambda a, _: step(a["lo"], a["hi"]), lambda a: a["lo"]))


def _clear_of(base: Column, use: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``use(clear)``, where ``clear(span)`` tells whether a span overlaps none of ``base``.

    As many of them end at or before the span's start as start before its end, counted in the sorted starts and ends.
    """
    starts = F.array_sort(F.transform(base, lambda b: b["start"]))
    ends = F.array_sort(F.transform(base, lambda b: b["end"]))
    return bound(starts, lambda s: bound(ends, lambda e: use(
        lambda span: _before(s, span["end"]) == _before(e, span["start"], or_at=True))))


def fresh(name: str, columns: list[str]) -> str:
    while name in columns:
        name += "_"
    return name


def add_spans(docs: DataFrame, base: str, spans: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with columns ``base`` and ``spans``, arrays of ``start, rank, end, kind`` (code points, end exclusive).

    Base spans come from the fixed formats; they are found once and stored with the rows. A further token of ``TOKEN``
    is reported as ``markov`` if it overlaps no base span and its log-likelihood ratio exceeds the learned threshold.
    Shorter tokens are not judged: they hold too few transitions to tell a key from a name. A null text has no spans;
    repeated rows get the same spans; an empty table gives an empty result. All on the JVM, and in near linear time in
    the hits of a text.
    """
    clean = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = stored(docs.withColumn(base, base_spans(clean)), "secret-base")
    coded, limit = learn(found.select(F.col(key).alias("key"), clean.alias("text"), F.col(base).alias("base")), "key")
    ratios = F.from_json(F.lit(coded), "array<double>")
    tokens = spans_of(clean, TOKEN, MARKOV, len(BASE))
    values = F.when(clean.rlike(TOKEN), matches(clean, TOKEN)).otherwise(F.array().cast("array<string>"))
    judged = F.filter(F.arrays_zip(tokens.alias("s"), values.alias("v")), lambda z: _score(z["v"], ratios) > limit)
    extra = bound(F.transform(judged, lambda z: z["s"]), lambda own: F.when(F.size(base) == 0, own).otherwise(
        _clear_of(F.col(base), lambda clear: F.filter(own, clear))))
    return found.withColumn(spans, F.array_sort(F.concat(base, extra)))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key, n_assign, n_access, n_hex, base_sha256, spans`` (see :func:`add_spans`)."""
    marked = add_spans(docs.select(F.col(key), F.col(text).alias("_text")), "_base", "_spans", key, "_text")
    def count(kind: str) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind, _ in BASE]
    return marked.select(key, *counts, F.sha2(listed(F.col("_base")), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every secret span of the text replaced by ``MARK``; spans that touch or overlap become one.

    With starts and ends sorted apart, a run of touching spans begins where all spans before it have ended, and ends
    where the next one begins. The text is cut into pieces of ``CHUNK`` code points and each is redacted by the runs that
    meet it, found by halving; a run's mark goes where the run begins.
    """
    base, spans = fresh("_base", docs.columns), fresh("_spans", docs.columns)
    marked = add_spans(docs, base, spans, key, text)
    starts = F.array_sort(F.transform(spans, lambda s: s["start"]))
    ends = F.array_sort(F.transform(spans, lambda s: s["end"]))

    def redacted(begin: Column, end: Column) -> Column:
        return F.array_join(F.transform(chunks_of(F.col(text).cast("string")), lambda chunk, c: _redacted_chunk(chunk, c * CHUNK, begin, end)), "")

    def runs(s: Column, e: Column) -> Column:
        n = F.size(s)
        begin = F.filter(s, lambda x, i: (i == 0) | (F.element_at(e, F.greatest(i, F.lit(1))) < x))
        end = F.filter(e, lambda x, i: (i == n - 1) | (F.element_at(s, F.least(i + 2, n)) > x))
        return bound(begin, lambda b: bound(end, lambda x: redacted(b, x)))

    clean = bound(starts, lambda s: bound(ends, lambda e: runs(s, e)))
    return marked.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(F.col(text))).select(*docs.columns)


def _redacted_chunk(chunk: Column, offset: Column, begin: Column, end: Column) -> Column:
    """A piece of text from ``offset`` on, without what the runs ``begin``, ``end`` cover, marked where a run begins."""
    length = F.length(chunk)

    def cut(first: Column, n: Column) -> Column:
        own = F.transform(F.sequence(first + 1, first + n), lambda i: F.struct(
            (F.element_at(begin, i) - offset).alias("a"), (F.element_at(end, i) - offset).alias("b")))
        return bound(own, lambda r: F.concat(F.array_join(F.transform(r, lambda z, i: F.concat(
            _between(chunk, F.when(i > 0, F.element_at(r, F.greatest(i, F.lit(1)))["b"]).otherwise(F.lit(0)), z["a"]),
            F.when(z["a"] >= 0, F.lit(MARK)).otherwise(F.lit("")))), ""), _between(chunk, F.element_at(r, -1)["b"], length)))

    done, met = _before(end, offset, or_at=True), _before(begin, offset + length)
    return bound(F.struct(done.alias("done"), (met - done).alias("n")), lambda z: F.when(z["n"] > 0, cut(z["done"], z["n"])).otherwise(chunk))


def _between(text: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end``, nothing where that is empty; ``start`` is 0 at least."""
    return F.when(end > start, F.substring(text, start + 1, end - start)).otherwise(F.lit(""))
