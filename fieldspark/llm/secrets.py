"""Secret scans with built-in functions only.

Base spans come from three regular expressions (``assign``, ``access``, ``hex``), leftmost and
non-overlapping for each kind. The method adds spans of kind ``entropy``: in candidate strings of at least
``WINDOW`` characters a window slides along; symbol counts and the sum of c * log2(c) are updated by the
symbol that leaves and the one that enters, and give the window's Shannon entropy. Windows whose
entropy reaches the threshold of the candidate's character class mark a span, from the first to the end of
the last such window. Digits alone never do; letters alone do where a run of 16 or more of them looks random
(shorter runs, also joined ones, pass for words). Candidates that match an allow-list pattern mark none; base spans are never suppressed.

A match's place is found without positions from the regex engine: the text is split at the matches, so
a match starts after the parts before it and the matches between them, in code points.

Defined results: null text counts as empty; every row is scanned alone, so repeated rows and ids are fine;
an empty table gives no rows; extra columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filled

# The base patterns. ``+`` with a length filter afterwards equals a counted repeat only where
# no shorter match can hide a longer one, which holds for access and hex.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: Matches that are gathered in one array before it joins the others.
SOME = 256
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Character classes in the order they are tried, and the bits a character that a window needs.
CLASSES = ((r"^[0-9]+$", 9.0), (r"^[0-9a-fA-F]+$", 3.0), (r"^[A-Za-z]+$", 3.9), (r"^[A-Za-z0-9]+$", 3.7), (r"^.+$", 4.0))
#: Strings that look random but are known to be harmless.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]?(?:key|token|secret)",
    r"(?i)0123456789|abcdefghijkl|(?:deadbeef){2}",
    r"^(?:[A-Za-z_-]+/)+[A-Za-z_-]*$",
    r"^[A-Za-z]{1,15}(?:[-_/=+]+[A-Za-z]{1,15})*[-_/=+]*$",
)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def found(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Array of structs (start, kind, end) of the matches; with ``group``, only where it has ``least`` characters."""
    p, none = F.lit(pattern), F.expr("cast(array() as array<struct<start: int, kind: int, end: int>>)")
    parts = F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, p, F.lit(0)).alias("whole"), (F.regexp_extract_all(text, p, F.lit(group)) if group else F.expr("cast(null as array<string>)")).alias("inner"))

    def step(x: Column):
        def one(acc: Column, i: Column) -> Column:
            def ended(start: Column, end: Column) -> Column:
                more = F.array_append(acc["out"], F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
                kept = F.when(F.char_length(F.element_at(x["inner"], i)) < least, acc["out"]).otherwise(more) if group else more
                return F.struct(end.alias("at"), kept.alias("out"))

            begin = acc["at"] + F.char_length(F.element_at(x["parts"], i))
            return let(begin, lambda start: let(start + F.char_length(F.element_at(x["whole"], i)), lambda end: ended(start, end)))

        return one

    def places(x: Column) -> Column:
        # matches are gathered some at a time, so that no long array is copied for each of them
        def block(acc: Column, b: Column) -> Column:
            own = F.sequence(b * SOME + 1, F.least(F.size(x["whole"]), b * SOME + SOME))
            inner = F.aggregate(own, F.struct(acc["at"].alias("at"), none.alias("out")), step(x))
            return let(inner, lambda r: F.struct(r["at"].alias("at"), F.array_append(acc["out"], r["out"]).alias("out")))

        blocks = F.sequence(F.lit(0), F.floor((F.size(x["whole"]) - 1) / SOME).cast("int"))
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<struct<start: int, kind: int, end: int>>>)").alias("out"))
        return F.when(F.size(x["whole"]) > 0, F.flatten(F.aggregate(blocks, start, block, lambda acc: acc["out"]))).otherwise(none)

    return F.when(text.rlike(pattern), let(parts, places)).otherwise(none)


def threshold(candidate: Column) -> Column:
    out = F.lit(CLASSES[-1][1])
    for pattern, bits in reversed(CLASSES[:-1]):
        out = F.when(candidate.rlike(pattern), F.lit(bits)).otherwise(out)
    return out


def hot_range(candidate: Column) -> Column:
    """Struct (first, last): offsets in the candidate where its high-entropy windows begin and end; null without one.

    The state holds the count of each symbol in the window and the sum of c * log2(c). One step takes the
    symbol that leaves out of both and puts in the one that enters.
    """
    n = len(ALPHABET)
    weight = lambda c: c * F.log2(F.greatest(c, F.lit(1)))
    # entropy = log2(WINDOW) - sum / WINDOW; a little slack covers rounding
    def solve(x: Column) -> Column:
        codes, limit = x["codes"], x["limit"]
        empty = F.struct(F.array_repeat(F.lit(0), n).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

        def step(acc: Column, i: Column) -> Column:
            enters, leaves = F.element_at(codes, i), F.when(i > WINDOW, F.element_at(codes, F.greatest(i - WINDOW, F.lit(1)))).otherwise(0)
            without = F.when(i > WINDOW, F.transform(acc["counts"], lambda c, k: F.when(k + 1 == leaves, c - 1).otherwise(c))).otherwise(acc["counts"])

            def moved(counts: Column) -> Column:
                had = F.element_at(counts, enters)
                lost = F.when(i > WINDOW, let(F.element_at(acc["counts"], F.greatest(leaves, F.lit(1))), lambda c: weight(c) - weight(c - 1))).otherwise(0.0)
                total = acc["sum"] - lost + weight(had + 1) - weight(had)

                def marked(s: Column) -> Column:
                    hit = (i >= WINDOW) & (F.lit(WINDOW) * (F.log2(F.lit(float(WINDOW))) - limit) + F.lit(1e-6) >= s)
                    return F.struct(
                        F.transform(counts, lambda c, k: F.when(k + 1 == enters, c + 1).otherwise(c)).alias("counts"),
                        s.alias("sum"),
                        F.when(hit & (acc["first"] < 0), i - WINDOW).otherwise(acc["first"]).alias("first"),
                        F.when(hit, i).otherwise(acc["last"]).alias("last"),
                    )

                return let(total, marked)

            return let(without, moved)

        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), empty, step, lambda acc: F.when(acc["first"] >= 0, F.struct(acc["first"].alias("first"), acc["last"].alias("last"))))

    codes = F.transform(F.split(candidate, "", -1), lambda c: F.instr(F.lit(ALPHABET), c))
    codes = F.filter(codes, lambda c: c > 0)
    return let(F.struct(codes.alias("codes"), threshold(candidate).alias("limit")), solve)


def entropy_spans(text: Column, allowed: tuple[str, ...]) -> Column:
    """Structs (start, kind, end) of candidates' high-entropy ranges."""
    kind = len(KINDS) - 1
    none = F.expr("cast(array() as array<struct<start: int, kind: int, end: int>>)")

    def spans(x: Column) -> Column:
        def one(c: Column) -> Column:
            word = F.substring(text, c["start"] + 1, c["end"] - c["start"])

            def judged(w: Column) -> Column:
                ok = threshold(w) <= 8.0
                for pattern in allowed:
                    ok = ok & ~w.rlike(pattern)
                return F.when(ok, let(hot_range(w), lambda r: F.when(r.isNotNull(), F.struct((c["start"] + r["first"]).alias("start"), F.lit(kind).alias("kind"), (c["start"] + r["last"]).alias("end")))))

            return let(word, judged)

        return F.filter(F.transform(x, one), lambda s: s.isNotNull())

    return F.when(text.rlike(CANDIDATE), let(found(text, CANDIDATE, kind), spans)).otherwise(none)


def scan(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end; code points, end exclusive) and ``keep``."""
    keep = tuple(c for c in keep if c not in ("doc_id", "base", "spans"))
    text = F.col("__text")
    docs = docs.select("doc_id", filled("text").alias("__text"), *keep)
    base = F.array_sort(F.concat(found(text, ASSIGN, 0, 2, 8), found(text, ACCESS, 1), found(text, HEX, 2)))
    got = docs.withColumn("__base", base).withColumn("__more", entropy_spans(text, allowed)).drop("__text")
    names = F.array(*[F.lit(k) for k in KINDS])
    named = lambda a: F.transform(a, lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return got.select("doc_id", named(F.col("__base")).alias("base"), named(F.array_sort(F.concat("__base", "__more"))).alias("spans"), *keep)


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


# The same in DuckDB, with entropies of whole windows instead of incremental ones.
_SQL_ASSIGN = ASSIGN.replace("(?i:password|passwd|secret|token|api_?key)", "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))).replace("'", "''")


def _sql_found(pattern: str, kind: int, keep: str) -> str:
    return f"""SELECT doc_id, r, t, list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'start': (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT, 'kind': {kind}, 'end': (list_sum(list_transform(p[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))))::BIGINT, 'ok': {keep}}}), lambda s: s.ok) AS spans
    FROM (SELECT doc_id, r, t, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {2 if kind == 0 else 0}) AS g FROM d)"""


_LIMIT = "CASE " + " ".join(f"WHEN regexp_matches(w, '{p}') THEN {b}::DOUBLE" for p, b in CLASSES) + " END"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
a AS ({_sql_found(_SQL_ASSIGN, 0, "length(g[i]) >= 8")}), k AS ({_sql_found(ACCESS, 1, "true")}), h AS ({_sql_found(HEX, 2, "true")}),
c AS (SELECT r, unnest(spans) AS s, t FROM ({_sql_found(CANDIDATE, 3, "true")})),
w AS (SELECT r, s.start AS b, substr(t, s.start + 1, s."end" - s.start) AS w FROM c),
ok AS (SELECT r, b, w, {_LIMIT} AS bits FROM w WHERE {" AND ".join(f"NOT regexp_matches(w, '{p}')" for p in ALLOWED)}),
win AS (SELECT r, b, bits, i, substr(w, i, {WINDOW}) AS x FROM (SELECT r, b, w, bits, unnest(range(1, length(w) - {WINDOW} + 2)) AS i FROM ok WHERE bits <= 8)),
hot AS (SELECT r, b, min(i) - 1 AS first, max(i) - 1 + {WINDOW} AS last FROM win
  WHERE log2({WINDOW}) - list_sum(list_transform(range(1, {WINDOW} + 1), lambda j: log2({WINDOW} - length(replace(x, x[j], ''))))) / {WINDOW} >= bits - 1e-6 / {WINDOW} GROUP BY r, b),
e AS (SELECT r, list({{'start': (b + first)::BIGINT, 'kind': 3, 'end': (b + last)::BIGINT, 'ok': true}}) AS spans FROM hot GROUP BY r),
j AS (SELECT d.doc_id, len(a.spans)::BIGINT AS n_assign, len(k.spans)::BIGINT AS n_access, len(h.spans)::BIGINT AS n_hex,
  list_sort(list_concat(list_concat(a.spans, k.spans), h.spans)) AS base, list_sort(list_concat(list_concat(list_concat(a.spans, k.spans), h.spans), coalesce(e.spans, []))) AS every
  FROM d JOIN a USING (r) JOIN k USING (r) JOIN h USING (r) LEFT JOIN e USING (r)),
n AS (SELECT *, lambda_names FROM j, (SELECT ['assign', 'access', 'hex', 'entropy'] AS lambda_names))
SELECT doc_id, n_assign, n_access, n_hex,
  sha256(coalesce(array_to_string(list_transform(base, lambda s: lambda_names[s.kind + 1] || ':' || s.start || ':' || s."end"), ','), '')) AS base_sha256,
  coalesce(array_to_string(list_transform(every, lambda s: lambda_names[s.kind + 1] || ':' || s.start || ':' || s."end"), ','), '') AS spans
FROM n
"""
