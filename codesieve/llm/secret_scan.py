"""Secret scans with Spark's own functions only.

Base spans come from three patterns (assignments, access keys, hex runs). The method adds ``entropy``
spans: over each candidate string a window of ``WINDOW`` characters slides; the counts of its characters
and the sum of c * log2(c) are updated for the character that enters and the one that leaves, and the
window is hot if its Shannon entropy reaches the threshold of the candidate's character class. An
allow-list suppresses identifiers, numbers and placeholders; base spans are never suppressed. Hosts, file
names, words of paths and placeholders within a candidate, and base spans, are cut out of it; the stretches
that remain are searched on their own, so that what stands beside them is found.

Edge cases: a null text is an empty one (no spans; the hash of the empty string); positions are code
points with exclusive ends; repeated rows give repeated results; empty tables give empty results; other
columns are not read. Texts are scanned whole, whatever their length. Nothing is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 20
#: Matches that are gathered at a time.
RUN = 64

# The patterns of the base kinds with the shortest match that counts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
#: Runs only grow to the right, so a least length in the pattern drops the same matches as a later filter.
ACCESS = rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}"
HEX = rf"[0-9a-f]{{{HEX_LEAST},}}"
KINDS = ("assign", "access", "hex", "entropy")

#: Candidate strings: long runs, each matched once and never given back; those without a digit are left out afterwards.
CANDIDATE = rf"[A-Za-z0-9+/_=.-]{{{WINDOW},}}+"
#: Character classes in the order tried, with the entropy in bits that a window must reach.
CLASSES = (("[0-9a-fA-F]+", 3.0), ("[A-Za-z0-9]+", 3.6), ("[A-Za-z0-9+/_=.-]+", 3.8))
#: Not secrets: numbers and dates, UUIDs, names of sites, paths of pages, placeholders.
ALLOWED = r"^[0-9.+/_=-]+$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|(?i)example|sample|dummy|placeholder|changeme|xxxx|\.(com|org|net|html?|php)\b|^/|//"

#: Of those, what a candidate or stretch must be as a whole.
NUMBER = "|".join(ALLOWED.split("|")[:2])
#: The others, cut out of a candidate: whole segments that are a host, a file or words of a path, and whole placeholders.
#: Their repeats are possessive: a segment ends at the next slash, so nothing is found by giving back.
HOST, PATH, PLACEHOLDER = r"(?:[A-Za-z0-9_-]++\.)++(?i:com|org|net|html?|php)", r"[A-Z]?[a-z]{3,}+(?:[-_.](?:[A-Z]?[a-z]++|[0-9]++))*+", r"(?i:(?:example|sample|dummy|placeholder|changeme)[0-9]*|x{4,})"
NAME = rf"(?<![^/=]){HOST}(?![^/])|(?<=/){PATH}(?![^/])|(?<![A-Za-z0-9]){PLACEHOLDER}(?![A-Za-z0-9])"

_ANY = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{16}|" + CANDIDATE
_SPANS = "array<struct<start:bigint,ord:int,end:bigint>>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _places(text: Column, pattern: str) -> Column:
    """All matches as (start, match), from the pieces between them; in runs of ``RUN``, so that long texts take no time in the square of their matches."""
    place = "array<struct<start:bigint,match:string>>"
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))

    def run(x: Column, first: Column, at: Column) -> Column:
        def step(s: Column, k: Column) -> Column:
            start, match = s["at"] + F.length(F.element_at(x["pieces"], k)), F.element_at(x["found"], k)
            return let(start, lambda a: state(a + F.length(match), F.array_append(s["out"], F.struct(a.alias("start"), match.alias("match")))))

        return F.aggregate(F.sequence(first, F.least(first + RUN - 1, F.size(x["found"]))), state(at, F.array().cast(place)), step)

    def runs(x: Column) -> Column:
        start = state(F.lit(0).cast("bigint"), F.array().cast(f"array<{place}>"))
        firsts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(x["found"]), F.lit(1)), F.lit(RUN)), lambda k: k <= F.size(x["found"]))  # none if nothing is found
        return F.flatten(F.aggregate(firsts, start, lambda s, k: let(run(x, k, s["at"]), lambda r: state(r["at"], F.array_append(s["out"], r["out"]))))["out"])

    return let(F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), runs)


def _kind(text: Column, gate: str, pattern: str, order: int, least: int = 0) -> Column:
    places = _places(text, pattern)
    if least:
        places = F.filter(places, lambda p: F.length(F.regexp_extract(p["match"], pattern, 2)) >= least)
    spans = F.transform(places, lambda p: F.struct(p["start"].alias("start"), F.lit(order).alias("ord"), (p["start"] + F.length(p["match"])).alias("end")))
    return F.when(text.rlike(gate), spans.cast(_SPANS)).otherwise(F.array().cast(_SPANS))


def _hot_range(candidate: Column, threshold: Column) -> Column:
    """(first, last) of the hot windows of a candidate, nulls if none: start of the first and end of the last."""
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    empty = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def step(x: Column, s: Column, i: Column) -> Column:
        enters = F.element_at(x["codes"], i + 1)
        leaves = F.when(i >= WINDOW, F.element_at(x["codes"], i + 1 - WINDOW)).otherwise(F.lit(0))
        grown = F.element_at(s["counts"], enters)
        total = s["sum"] + F.element_at(weight, grown + 2) - F.element_at(weight, grown + 1)

        def shrunk(y: Column) -> Column:
            c = F.element_at(y["counts"], F.greatest(leaves, F.lit(1)))
            total = y["sum"] + F.when(leaves > 0, F.element_at(weight, c) - F.element_at(weight, c + 1)).otherwise(F.lit(0.0))
            counts = F.when(leaves > 0, F.transform(y["counts"], lambda n, k: n - (k == leaves - 1).cast("int"))).otherwise(y["counts"])

            def judged(z: Column) -> Column:
                hot = (i >= WINDOW - 1) & (math.log2(WINDOW) - z["sum"] / WINDOW >= threshold - 1e-9)
                return F.struct(
                    z["counts"].alias("counts"),
                    z["sum"].alias("sum"),
                    F.when(hot, F.coalesce(s["first"], i - WINDOW + 1)).otherwise(s["first"]).alias("first"),
                    F.when(hot, i + 1).otherwise(s["last"]).alias("last"),
                )

            return let(F.struct(counts.alias("counts"), total.alias("sum")), judged)

        return let(F.struct(F.transform(s["counts"], lambda n, k: n + (k == enters - 1).cast("int")).alias("counts"), total.alias("sum")), shrunk)

    def run(chars: Column) -> Column:
        def coded(alphabet: Column) -> Column:
            codes = F.transform(chars, lambda c: F.array_position(alphabet, c).cast("int"))
            return let(
                F.struct(codes.alias("codes"), F.array_repeat(F.lit(0), F.size(alphabet)).alias("zeros")),
                lambda x: F.aggregate(
                    F.sequence(F.lit(0), F.size(x["codes"]) - 1),
                    F.struct(x["zeros"].alias("counts"), *[empty[k].alias(k) for k in ("sum", "first", "last")]),
                    lambda s, i: step(x, s, i),
                    lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")),
                ),
            )

        return let(F.array_distinct(chars), coded)

    return let(F.split(candidate, ""), run)


def _stretches(place: Column, base: Column, bits: Column) -> Column:
    """(start, match, bits) of what lies outside base spans and names in a candidate and is as long as a window."""
    start, match, end = place["start"], place["match"], place["start"] + F.length(place["match"])
    hole = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    kind, none = "array<struct<start:bigint,end:bigint>>", F.array()
    names = F.when(match.rlike(ALLOWED), F.transform(_places(match, NAME), lambda n: hole(start + n["start"], start + n["start"] + F.length(n["match"]))).cast(kind)).otherwise(none.cast(kind))
    taken = F.transform(F.filter(base, lambda b: (b["start"] < end) & (start < b["end"])), lambda b: hole(b["start"], b["end"])).cast(kind)
    return F.aggregate(
        F.array_sort(F.concat(taken, names, F.array(hole(end, end)).cast(kind))),
        F.struct(start.cast("bigint").alias("at"), none.cast("array<struct<start:bigint,match:string,bits:double>>").alias("out")),
        lambda s, h: F.struct(
            F.greatest(s["at"], h["end"]).alias("at"),
            F.when(
                h["start"] - s["at"] >= WINDOW,
                F.array_append(s["out"], F.struct(s["at"].alias("start"), F.substring(match, (s["at"] - start + 1).cast("int"), (h["start"] - s["at"]).cast("int")).alias("match"), bits.cast("double").alias("bits"))),
            ).otherwise(s["out"]).alias("out"),
        ),
    )["out"]


def _entropy(text: Column, base: Column) -> Column:
    threshold = None
    for pattern, bits in CLASSES:
        threshold = (lambda c, old=threshold, p=pattern, b=bits: (F.when(c.rlike(f"^{p}$"), b) if old is None else old(c).when(c.rlike(f"^{p}$"), b)))
    stretches = F.flatten(F.transform(_places(text, CANDIDATE), lambda p: _stretches(p, base, threshold(p["match"]))))
    places = F.filter(stretches, lambda p: p["match"].rlike("[0-9]") & ~p["match"].rlike(NUMBER))
    spans = F.transform(
        places,
        lambda p: let(
            _hot_range(p["match"], p["bits"]),
            lambda r: F.struct((p["start"] + r["first"]).alias("start"), F.lit(3).alias("ord"), (p["start"] + r["last"]).alias("end")),
        ),
    )
    return F.when(text.rlike(CANDIDATE), F.filter(spans, lambda s: s["start"].isNotNull()).cast(_SPANS)).otherwise(F.array().cast(_SPANS))


def _base(text: Column) -> Column:
    """The base spans of a text, in order."""
    found = F.concat(
        _kind(text, r"(?i)password|passwd|secret|token|api_?key", ASSIGN, 0, ASSIGN_LEAST),
        _kind(text, "AKIA", ACCESS, 1),
        _kind(text, "[0-9a-f]{16}", HEX, 2),
    )
    return F.array_sort(found)


def with_spans(docs: DataFrame, text_column: str = "text", base: str = "base_spans", added: str = "entropy_spans") -> DataFrame:
    """Add two columns: the base spans and the method's own, each an array of (start, ord, end) in order."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    none = F.array().cast(_SPANS)
    docs = docs.withColumn(base, F.when(text.rlike(_ANY), _base(text)).otherwise(none))
    return docs.withColumn(added, F.when(text.rlike(_ANY), _entropy(text, F.col(base))).otherwise(none))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["ord"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy) of every document."""
    rows = with_spans(docs.select(id_column, text_column), text_column)
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["ord"] == k)).cast("bigint")
    return rows.select(
        id_column,
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(span_text(F.col("base_spans")), 256).alias("base_sha256"),
        span_text(F.array_sort(F.concat("base_spans", "entropy_spans"))).alias("spans"),
        F.size("entropy_spans").cast("bigint").alias("n_entropy"),
    )


def _masked(line: Column, spans: Column, mask: str) -> Column:
    piece = lambda lo, n: F.substring(line, (lo + 1).cast("int"), n.cast("int"))
    return F.aggregate(
        spans,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda s, x: F.when(
            x["start"] >= s["at"],
            F.struct(x["end"].alias("at"), F.concat(s["out"], piece(s["at"], x["start"] - s["at"]), F.lit(mask)).alias("out")),
        ).otherwise(F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))),
        lambda s: F.concat(s["out"], piece(s["at"], F.length(line))),
    )


def redact_secrets(docs: DataFrame, text_column: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The documents with every span of ``scan_secrets`` replaced by ``mask``; overlapping spans become one mask.

    No pattern reaches beyond its line, so lines are masked one by one.
    """
    text = F.col(text_column)

    def line(x: Column) -> Column:
        spans = let(_base(x), lambda base: F.array_sort(F.concat(base, _entropy(x, base))))
        return F.when(x.rlike(_ANY), let(spans, lambda found: _masked(x, found, mask))).otherwise(x)

    return docs.withColumn(text_column, F.when(text.rlike(_ANY), F.array_join(F.transform(F.split(text, "\n", -1), line), "\n")).otherwise(text))
