"""SQL by which another engine checks the license and secret scans, the filter audit and the resampling, built from their fixed values."""

from __future__ import annotations

import math
from itertools import permutations

from codesieve.llm import filter_audit, importance_resample, license_scan, secret_scan


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(map(_quoted, words)) + "]"


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def license_sql() -> str:
    """All columns of the license scan."""
    places, labels = [], []
    for phrase, label in license_scan.PHRASES.items():
        words = phrase.split(" ")
        same = " AND ".join(f"ws[i + {k}] = {_quoted(w)}" for k, w in enumerate(words))
        places.append(f"list_transform(list_filter(range(1, len(ws) + 1), lambda i: {same}), lambda i: {{'at': i - 1, 'label': {_quoted(label)}}})")
    found = places[0]
    for place in places[1:]:
        found = f"list_concat({found}, {place})"
    words = [(k, label, license_scan.words_of(text)) for k, (label, text) in enumerate(license_scan.TEMPLATES)]
    least, width = (lambda n: math.ceil(license_scan.THRESHOLD * n - 1e-9)), (lambda n: math.ceil(n / license_scan.THRESHOLD - 1e-9))
    templates = ", ".join(f"({k}, {_quoted(label)}, {_quoted(w)}, {len(set(ws))}, {least(len(set(ws)))}, {width(len(ws))})" for k, label, ws in words for w in sorted(set(ws)))
    return f"""
WITH docs AS (SELECT doc_id, {_LOWERED} AS t FROM documents),
words AS (SELECT doc_id, regexp_extract_all(t, {_WORDS}) AS ws FROM docs),
base AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, {found} AS p FROM words),
templates(k, label, word, tokens, least, width) AS (VALUES {templates}),
hits AS (SELECT doc_id, i, t.* FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM words) w JOIN templates t USING (word)),
able AS (SELECT doc_id, k FROM hits GROUP BY ALL HAVING count(DISTINCT word) >= any_value(least)),
near AS (SELECT hits.* FROM hits JOIN able USING (doc_id, k)),
reached AS (SELECT a.doc_id, a.label, count(DISTINCT b.word) / any_value(a.tokens) AS score FROM near a JOIN near b ON a.doc_id = b.doc_id AND a.k = b.k AND b.i BETWEEN a.i AND a.i + a.width - 1
    GROUP BY a.doc_id, a.label, a.k, a.i HAVING count(DISTINCT b.word) >= any_value(a.least)),
best AS (SELECT doc_id, list(DISTINCT label) AS labels, max(score) AS score FROM reached GROUP BY 1)
SELECT doc_id, n_words, CAST(len(p) AS BIGINT) AS n_base, CAST(list_min(list_transform(p, lambda x: x.at)) AS BIGINT) AS first_word, CAST(list_max(list_transform(p, lambda x: x.at)) AS BIGINT) AS last_word,
    coalesce(array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(list_transform(p, lambda x: x.label), coalesce(labels, [])))), ','), '') AS labels,
    CASE WHEN len(p) > 0 THEN 1.0::DOUBLE ELSE coalesce(best.score, 0)::DOUBLE END AS score
FROM base LEFT JOIN best USING (doc_id)"""


def _spans(pattern: str, text: str = "t") -> str:
    """Struct list (start, match) of all matches in ``text``."""
    p = _quoted(pattern)
    start = f"length(array_to_string(string_split_regex({text}, {p})[1:k], '')) + length(array_to_string(regexp_extract_all({text}, {p})[1:k-1], ''))"
    return f"CASE WHEN regexp_matches({text}, {p}) THEN list_transform(range(1, len(regexp_extract_all({text}, {p})) + 1), lambda k: {{'start': {start}, 'match': regexp_extract_all({text}, {p})[k]}}) ELSE [] END"


def _plain(pattern: str) -> str:
    """A pattern without possessive repeats, which only save time."""
    return pattern.replace("++", "+").replace("*+", "*").replace("}+", "}")


def secret_sql() -> str:
    """All columns of the secret scan; the entropy of each window is counted anew.

    Names are found slash by slash and word by word, since there is no looking behind here; stretches are the gaps between
    the ends so far and the next start of what is cut out of a candidate.
    """
    kinds = [(secret_scan.ASSIGN, f"length(regexp_extract(s.match, {_quoted(secret_scan.ASSIGN)}, 2)) >= {secret_scan.ASSIGN_LEAST}"), (secret_scan.ACCESS, "true"), (secret_scan.HEX, "true")]
    base = " UNION ALL ".join(f"SELECT doc_id, {k} AS ord, s.start AS a, s.start + length(s.match) AS b FROM (SELECT doc_id, unnest({_spans(p)}) AS s FROM docs) WHERE {where}" for k, (p, where) in enumerate(kinds))
    bits = "CASE " + " ".join(f"WHEN regexp_full_match(m, {_quoted(p)}) THEN {least}" for p, least in secret_scan.CLASSES) + " END"
    size = secret_scan.WINDOW
    host, path = _quoted(f"(?:^|=)({_plain(secret_scan.HOST)})$"), _quoted(_plain(secret_scan.PATH))
    names = "CASE ord " + " ".join(f"WHEN {k} THEN {_quoted(n)}" for k, n in enumerate(secret_scan.KINDS)) + " END"
    joined = lambda source: f"SELECT doc_id, string_agg({names} || ':' || a || ':' || b, ',' ORDER BY a, ord, b) AS text FROM {source} GROUP BY 1"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({base}),
runs AS (SELECT doc_id, s.start AS begun, s.match AS m, {bits.replace('(m,', '(s.match,')} AS bits FROM (SELECT doc_id, unnest({_spans(_plain(secret_scan.CANDIDATE))}) AS s FROM docs) WHERE regexp_matches(s.match, '[0-9]')),
named AS (SELECT * FROM runs WHERE regexp_matches(m, {_quoted(secret_scan.ALLOWED)})),
segments AS (SELECT doc_id, begun, k, split[k] AS segment, length(array_to_string(split[1:k - 1], '/')) + CASE WHEN k > 1 THEN 1 ELSE 0 END AS place
    FROM (SELECT *, unnest(range(1, len(split) + 1)) AS k FROM (SELECT *, string_split(m, '/') AS split FROM named))),
holes AS (SELECT doc_id, begun, begun + place + length(segment) - length(regexp_extract(segment, {host}, 1)) AS a, begun + place + length(segment) AS b FROM segments WHERE regexp_matches(segment, {host})
    UNION ALL SELECT doc_id, begun, begun + place, begun + place + length(segment) FROM segments WHERE k > 1 AND regexp_full_match(segment, {path})
    UNION ALL SELECT doc_id, begun, begun + s.start, begun + s.start + length(s.match) FROM (SELECT doc_id, begun, unnest({_spans('[A-Za-z0-9]+', 'm')}) AS s FROM named) WHERE regexp_full_match(s.match, {_quoted(secret_scan.PLACEHOLDER)})
    UNION ALL SELECT r.doc_id, begun, x.a, x.b FROM runs r JOIN base x ON x.doc_id = r.doc_id AND x.a < begun + length(m) AND begun < x.b
    UNION ALL SELECT doc_id, begun, begun + length(m), begun + length(m) FROM runs),
gaps AS (SELECT doc_id, begun, a AS till, greatest(begun, coalesce(max(b) OVER (PARTITION BY doc_id, begun ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), begun)) AS since FROM holes),
stretches AS (SELECT doc_id, since, bits, m[since - begun + 1:till - begun] AS m FROM gaps JOIN runs USING (doc_id, begun) WHERE till - since >= {size}),
windows AS (SELECT doc_id, since, bits, i, list_aggregate(string_split(m[i + 1:i + {size}], ''), 'entropy') AS h FROM (SELECT *, unnest(range(0, length(m) - {size - 1})) AS i FROM stretches WHERE regexp_matches(m, '[0-9]') AND NOT regexp_matches(m, {_quoted(secret_scan.NUMBER)}))),
own AS (SELECT doc_id, 3 AS ord, since + min(i) AS a, since + max(i) + {size} AS b FROM windows WHERE h >= bits - 1e-9 GROUP BY doc_id, since),
sums AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex FROM base GROUP BY 1),
extra AS (SELECT doc_id, count(*) AS n_entropy FROM own GROUP BY 1),
first AS ({joined('base')}), every AS ({joined('(SELECT * FROM base UNION ALL SELECT * FROM own)')})
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(first.text, '')) AS base_sha256, coalesce(every.text, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM docs LEFT JOIN sums USING (doc_id) LEFT JOIN extra USING (doc_id) LEFT JOIN first USING (doc_id) LEFT JOIN every USING (doc_id)"""


def audit_sql() -> str:
    """All columns of the filter audit, from the documents themselves instead of cells."""
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations(filter_audit.FILTERS))
    earlier = "list_bool_or(list_transform(range(1, step), lambda k: mask[ord(filter_order[k]) - 64]))"
    return rf"""
WITH marked AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1),
docs AS (SELECT d.doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM documents d LEFT JOIN marked USING (doc_id)),
judged AS (SELECT *, regexp_extract_all(t, '[^ 	-
]+') AS ws, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS copied FROM docs),
masks AS (SELECT part, good, toxic, [len(ws) < {filter_audit.LEAST_WORDS}, 100 * len(list_distinct(ws)) < {filter_audit.LEAST_DISTINCT} * len(ws),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {filter_audit.MOST_CAPITALS} * length(t), regexp_matches(t, '{filter_audit.SYMBOLS}'), copied] AS mask FROM judged),
counted AS (SELECT part, good, toxic, mask, count(*) AS n FROM masks GROUP BY ALL),
steps AS (SELECT c.*, filter_order, step, mask[ord(filter_order[step]) - 64] AS fails, coalesce({earlier}, false) AS gone FROM counted c, (VALUES {orders}) o(filter_order), (SELECT unnest(range(1, 6)) AS step)),
told AS (SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant,
    coalesce(sum(n) FILTER (fails AND len(list_filter(mask, lambda x: x)) = 1), 0) AS unique_fails, coalesce(sum(n) FILTER (fails AND NOT gone AND good), 0) AS good_lost, coalesce(sum(n) FILTER (fails AND NOT gone AND toxic), 0) AS toxic_lost
    FROM steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM told"""


def resample_sql() -> str:
    """All columns of the resampling; CRC-32 from its polynomial, each distinct run hashed once."""
    r = importance_resample
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    for _ in range(7):
        bit = f"list_transform([{bit}], lambda c: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)[1]"
    return f"""
WITH crc AS (SELECT list_transform(list_transform(range(0, 256), lambda c: c::UBIGINT), lambda c: {bit}) AS steps),
words AS (SELECT doc_id, 0 AS side, regexp_extract_all({_LOWERED}, {_WORDS}) AS ws FROM documents UNION ALL SELECT NULL, 1, regexp_extract_all({_LOWERED}, {_WORDS}) FROM benchmark),
numbered AS (SELECT *, row_number() OVER () AS row FROM words),
runs AS (SELECT row, side, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS run FROM numbered),
counted AS (SELECT row, side, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, xor(list_reduce(list_transform(range(1, len(hex(encode(run))), 2), lambda k: ('0x' || hex(encode(run))[k:k + 1])::UBIGINT),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255)::BIGINT + 1]), 4294967295::UBIGINT), 4294967295) % {r.BUCKETS} AS bucket FROM (SELECT DISTINCT run FROM counted), crc),
buckets AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM counted JOIN hashed USING (run) GROUP BY 1),
totals AS (SELECT coalesce(sum(s), 0) AS sa, coalesce(sum(t), 0) AS ta FROM buckets),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sa + {r.BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (ta + {r.BUCKETS})::DOUBLE)))::BIGINT AS gain FROM buckets, totals),
weights AS (SELECT row, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM counted JOIN hashed USING (run) JOIN gains USING (bucket) WHERE side = 0 GROUP BY 1),
scored AS (SELECT doc_id, row, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{r.SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM numbered LEFT JOIN weights USING (row) WHERE side = 0),
drawn AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank FROM scored WHERE n_words >= {r.LEAST_WORDS} QUALIFY rank <= (SELECT {r.PERCENT} * count(*) // 100 FROM scored WHERE n_words >= {r.LEAST_WORDS}))
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN drawn USING (row)"""
