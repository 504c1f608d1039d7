"""Operator 7, secret scan with character Markov models (DataFrame functions only).

Three fixed patterns give the base spans. A first-order character model of random strings (trained on
the corpus's own base matches) and one of ordinary identifiers (trained on the strings that recur in
sampled texts without base matches) score every further long token; a token whose log-likelihood ratio favours
"random" by ``MARGIN`` nats or more becomes a span of kind ``markov``.

Spans come from splitting a text by the pattern: the pieces between matches and the matches alternate,
so positions are running totals of lengths (code points). The texts are read once; what later steps
use (spans and tokens) is written narrow under the shared folder. The models are tables of at most
``len(ALPHABET)^2`` counts, whatever the corpus.

Fitting reads all base matches and, for ordinary words, about ``SAMPLE_TEXTS`` texts at most chosen by a
hash of key and content (the documented bound of the training sample); scoring reads everything.

Defined cases: a NULL text is empty; without base matches or ordinary words to train on, no
``markov`` spans are added; spans of one kind never overlap, spans of different kinds may; a token that
touches a base span is left to it; repeated rows give a row each; a NULL id is carried; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import bind, or_empty, prefix_sums

# Fixed values of the contract: kinds in order, pattern, group that must be long enough, its least length
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32

TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
MARGIN = 8.0
BACKOFF = 32.0  # weight of a character's own frequency, in transitions
SAMPLE_TEXTS = 20_000
SPAN = "struct<start:bigint,kind:int,end:bigint,value:string>"


def _spans(text: Column, pattern: str, kind: int, group: int, least: int, guard: str) -> Column:
    """Leftmost non-overlapping matches whose ``group`` has ``least`` characters. ``guard`` is a cheap
    condition without which no match can pass; most texts stop there."""
    def place(gaps, found, values):
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("long"))
        return bind(prefix_sums(steps), lambda at: F.filter(F.transform(found, lambda m, i: F.struct(
            (F.get(at, i) + F.length(F.get(gaps, i))).alias("start"), F.lit(kind).alias("kind"),
            (F.get(at, i) + F.length(F.get(gaps, i)) + F.length(m)).alias("end"),
            F.get(values, i).alias("value"))), lambda s: F.length(s["value"]) >= least))

    def matches(t):
        return bind(F.split(t, pattern), lambda gaps: bind(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda found: bind(
            F.regexp_extract_all(t, F.lit(pattern), F.lit(group)), lambda values: place(gaps, found, values))))

    return F.when(F.rlike(text, F.lit(guard)), matches(text)).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    """Base spans in (start, kind) order."""
    # a run of hex digits is maximal wherever it starts, so asking for 32 of them gives the same spans
    return F.sort_array(F.concat(
        _spans(text, ASSIGN, 0, 1, MIN_ASSIGN, ASSIGN), _spans(text, ACCESS, 1, 0, MIN_ACCESS, ACCESS),
        _spans(text, HEX[:-1] + "{%d,}" % MIN_HEX, 2, 0, MIN_HEX, HEX[:-1] + "{%d}" % MIN_HEX)))


def _free_tokens(tokens: Column, base: Column) -> Column:
    """Tokens that touch no base span. Those equal to one go first, by a hash set; few remain to compare."""
    flat = lambda a: F.transform(a, lambda s: F.concat_ws(  # noqa: E731  no field holds a colon
        ":", s["start"].cast("string"), s["end"].cast("string"), s["value"]))

    def span(parts):
        return F.struct(F.get(parts, F.lit(0)).cast("long").alias("start"), F.lit(KINDS.index("markov")).alias("kind"),
                        F.get(parts, F.lit(1)).cast("long").alias("end"), F.get(parts, F.lit(2)).alias("value"))

    left = F.transform(F.array_except(flat(tokens), flat(base)), lambda x: bind(F.split(x, ":"), span))
    free = F.filter(left, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return F.when(F.size(base) == 0, tokens).otherwise(free)


def scan_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key_, base, tokens)``: base spans and the further long tokens of every row."""
    t = or_empty(F.col(text))
    rows = docs.select(F.col(key).alias("key_"), base_spans(t).alias("base"),
                       _spans(t, TOKEN, 3, 0, 1, TOKEN).alias("tokens"))
    return rows.select("key_", "base", bind(F.col("tokens"), lambda a: bind(F.col("base"), lambda b: _free_tokens(a, b))).alias("tokens"))


def _transitions(strings: DataFrame, column: str) -> DataFrame:
    """``(a, b, n)``: how often a character of the alphabet is followed by another."""
    chars = F.filter(F.split(F.regexp_replace(F.col(column), r"[^A-Za-z0-9+/_=-]", ""), ""), lambda c: c != "")
    pairs = strings.select(bind(chars, lambda c: F.zip_with(F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))),
                                                            F.slice(c, F.lit(2), F.size(c)), lambda a, b: F.concat(a, b))).alias("p"))
    return pairs.select(F.explode("p").alias("p")).filter(F.length("p") == 2).groupBy("p").agg(F.count("*").alias("n"))


def _log_rows(counts: dict[str, int]) -> dict[str, float]:
    """Log transition probabilities, each row backed off to the characters' own frequencies: a transition
    that was never seen is as likely as its second character is common, not as a uniform draw."""
    seen = {b: 0.5 + sum(counts.get(a + b, 0) for a in ALPHABET) for b in ALPHABET}
    total = sum(seen.values())
    out = {}
    for a in ALPHABET:
        n = sum(counts.get(a + b, 0) for b in ALPHABET)
        for b in ALPHABET:
            out[a + b] = math.log((counts.get(a + b, 0) + BACKOFF * seen[b] / total) / (n + BACKOFF))
    return out


def train(scanned: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", sample_texts: int = SAMPLE_TEXTS) -> list[float] | None:
    """Log-likelihood ratios of all transitions, row by row of the alphabet; None if a class has no sample."""
    random = scanned.filter(F.size("base") > 0).select(F.explode("base").alias("s")).select(F.col("s.value").alias("v"))
    total = docs.count()
    share = min(1.0, sample_texts / max(total, 1))
    ordinary = docs.filter(F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(1 << 20)) < int(share * (1 << 20)) + (share >= 1.0)) \
        .filter(~F.rlike(or_empty(F.col(text)), F.lit(f"{ASSIGN}|{ACCESS}|[0-9a-f]{{{MIN_HEX}}}"))) \
        .select(F.explode(F.array_distinct(F.regexp_extract_all(or_empty(F.col(text)), F.lit(r"[A-Za-z0-9+/_=-]{2,}"), F.lit(0)))).alias("v")) \
        .groupBy("v").agg(F.count("*").alias("n")).filter("n > 1").select("v")  # a random string does not recur
    models = []
    for sample in (random, ordinary):
        counts = {r["p"]: r["n"] for r in _transitions(sample, "v").collect()}  # at most len(ALPHABET)^2 rows
        if not counts:
            return None
        models.append(_log_rows(counts))
    return [models[0][a + b] - models[1][a + b] for a in ALPHABET for b in ALPHABET]


def likelihood_ratio(token: Column, ratios: Column) -> Column:
    """Sum of the log-likelihood ratios of a token's transitions."""
    places = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(ALPHABET)) - 1)
    return bind(places, lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(0.0), lambda acc, i: acc + F.get(
        ratios, F.get(p, i - 1) * len(ALPHABET) + F.get(p, i))))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", margin: float = MARGIN,
         sample_texts: int = SAMPLE_TEXTS) -> DataFrame:
    """``key`` and ``spans``: all spans ``(start, kind, end, value)`` in (start, kind) order."""
    scanned = materialize(scan_texts(docs, key, text), "secret-spans")
    ratios = train(scanned, docs, key, text, sample_texts)
    found = F.col("base")
    if ratios is not None:
        table = F.array(*map(F.lit, ratios))
        found = F.concat("base", F.filter("tokens", lambda s: likelihood_ratio(s["value"], table) >= margin))
    return scanned.select(F.col("key_").alias(key), F.sort_array(found).alias("spans"))


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
