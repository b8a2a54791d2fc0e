"""Secrets found through a trigram index: each rule's Boolean trigram query is answered from postings, and only the texts
that are left are searched with its pattern.  Rules without a mandatory trigram search every text.  DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored
from .trigrams import required


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates from left to right; those whose ``group`` has fewer than ``least`` characters fall away."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# fixed values: the first three are the base rules, the others add known formats of credentials
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE


#: elements that a running fold handles at a time; the work for n of them grows as n * SLICE + (n / SLICE)^2 / 2 copies of references
SLICE = 64


def running(n: Column, first: Column, step, out: str) -> Column:
    """array<``out``> of ``n`` elements: ``step(state, i)`` gives the next state and the element of place i.

    An array that a fold appends to is copied each time, so places are folded in slices and the slices' arrays are put together."""
    none, nones = F.array().cast(f"array<{out}>"), F.array().cast(f"array<array<{out}>>")

    def inner(acc: Column, i: Column) -> Column:
        return F.transform(F.array(step(acc["state"], i)), lambda got: F.struct(got["state"].alias("state"), F.concat(acc["out"], F.array(got["out"])).alias("out")))[0]

    def outer(acc: Column, k: Column) -> Column:
        part = F.aggregate(F.sequence(k * SLICE, F.least(k * SLICE + SLICE, n) - 1), F.struct(acc["state"].alias("state"), none.alias("out")), inner)
        return F.transform(F.array(part), lambda got: F.struct(got["state"].alias("state"), F.concat(acc["out"], F.array(got["out"])).alias("out")))[0]

    whole = F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / SLICE).cast("int")), F.struct(first.alias("state"), nones.alias("out")), outer, lambda a: F.flatten(a["out"]))
    return F.when(n <= 0, none).otherwise(whole)


def spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, ord, kind, stop>> of the rule's matches in code points, the end exclusive.

    The text between matches and the matches themselves, laid end to end, give the places."""
    pattern = F.lit(rule.pattern)
    row = F.struct(F.split(text, rule.pattern, -1).alias("between"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"),
                   F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part"))

    def of(r: Column) -> Column:
        def step(at: Column, i: Column) -> Column:
            start = at + F.length(r["between"][i])
            stop = start + F.length(r["whole"][i])
            found = F.struct(start.cast("bigint").alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), stop.cast("bigint").alias("stop"))
            return F.struct(stop.cast("bigint").alias("state"), F.when(F.length(r["part"][i]) >= rule.least, found).alias("out"))

        return F.filter(running(F.size(r["whole"]), F.lit(0).cast("bigint"), step, "struct<start:bigint,ord:int,kind:string,stop:bigint>"), lambda x: x.isNotNull())

    # one evaluation of the three lists, handed on as the single element of an array
    return F.flatten(F.transform(F.array(row), of))


def vocabulary(rules=RULES) -> list[str]:
    """All trigrams that some rule asks for."""
    return sorted({g for r in rules for demand in required(r.pattern) for s in demand for g in s})


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, text (null: empty) and ``content``, a digest by which equal texts share their postings."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return df.select(F.col(f"`{key}`").alias("key"), t.alias("text"), F.unhex(F.md5(t)).alias("content"))


def index(texts: DataFrame, rules=RULES) -> DataFrame:
    """Postings: trigram and content, for the trigrams that the rules ask for."""
    grams = vocabulary(rules)
    low = texts.select("content", F.lower("text").alias("low"))
    there = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    return low.select("content", F.explode(there).alias("gram"))


def candidates(postings: DataFrame, rules=RULES) -> DataFrame:
    """content and one Boolean for each indexed rule, where at least one holds: the intersected postings."""
    grams = {g: i for i, g in enumerate(vocabulary(rules))}
    words = -(-len(grams) // 60)
    masks = [F.bit_or(F.expr(f"CASE WHEN gram DIV 60 = {w} THEN shiftleft(1L, gram % 60) ELSE 0L END")).alias(f"m{w}")
             for w in range(words)]
    got = postings.groupBy("content").agg(*masks)

    def has(gram: str) -> Column:
        i = grams[gram]
        return F.col(f"m{i // 60}").bitwiseAND(F.lit(1 << (i % 60))) != 0

    def met(rule: Rule) -> Column:
        sides = [reduce(Column.__or__, [reduce(Column.__and__, [has(g) for g in sorted(s)]) for s in sorted(demand, key=sorted)]) for demand in required(rule.pattern)]
        return reduce(Column.__and__, sides)

    flags = {r.kind: met(r) for r in rules if required(r.pattern)}
    return got.select("content", *[c.alias(f"is_{k}") for k, c in flags.items()]).where(reduce(Column.__or__, [F.col(f"is_{k}") for k in flags]))


#: a counted table of at most so many rows and matches is sent to the executors instead of dealing texts out by content
FEW_ROWS, FEW_SPANS = 200_000, 500_000


def _small(df: DataFrame, spans: str | None = None) -> DataFrame:
    got = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size(spans)), F.lit(0)).alias("spans") if spans else F.lit(0).alias("spans")).first()
    return F.broadcast(df) if got["rows"] <= FEW_ROWS and got["spans"] <= FEW_SPANS else df


def scan(df: DataFrame, *, key: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """One row for each row of ``df``: key, content and ``found``, the matches of all rules by start and then by rule.

    Whole texts are searched; a null text is empty. Matches of one rule do not overlap, those of different rules may.
    Repeated rows and null keys are kept; other columns are not read. Equal texts meet in one group of counts, not of rows."""
    texts = keyed(df, key, text)
    wanted = stored(candidates(index(texts, rules), rules), "candidates")
    indexed = [(i, r) for i, r in enumerate(rules) if required(r.pattern)]
    open_rules = [(i, r) for i, r in enumerate(rules) if not required(r.pattern)]
    none = F.array().cast("array<struct<start:bigint,ord:int,kind:string,stop:bigint>>")
    verified = (texts.select("content", "text").join(_small(wanted), "content")
                .select("content", F.concat(*[F.when(F.col(f"is_{r.kind}"), spans(F.col("text"), r, i)).otherwise(none) for i, r in indexed]).alias("verified"))
                .groupBy("content").agg(F.first("verified").alias("verified")).where(F.size("verified") > 0))
    every = [F.when(F.col("text").rlike(r.pattern), spans(F.col("text"), r, i)).otherwise(none) for i, r in open_rules]
    rows = texts.select("key", "content", (F.concat(*every) if every else none).alias("opened"))
    return rows.join(_small(stored(verified, "verified"), "verified"), "content", "left").select(
        F.col("key").alias(key), "content", F.array_sort(F.concat("opened", F.coalesce("verified", none))).alias("found"))


def listed(found: Column) -> Column:
    """kind:start:end of matches, joined by commas."""
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def summary(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digest of the base rules and the list of all matches."""
    base = F.filter("found", lambda s: s["ord"] < len(BASE))
    counts = [F.expr(f"cast(size(filter(found, s -> s.kind = '{r.kind}')) AS bigint) AS n_{r.kind}") for r in BASE]
    return found.select(key, *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def redact(df: DataFrame, *, key: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """``df`` with every match replaced by its kind in brackets; of overlapping matches the first names them all.

    Rows and columns stay as they are but for ``text``; a null text stays null. Texts meet their matches by content, so
    repeated keys are no matter."""
    found = scan(df, key=key, text=text, rules=rules).where(F.size("found") > 0).groupBy("content").agg(F.first("found").alias("found"))
    t = F.col(f"`{text}`").cast("string")
    names = fresh(df, "content", "found")
    marked = df.withColumn(names[0], F.unhex(F.md5(F.coalesce(t, F.lit(""))))).join(
        _small(stored(found.toDF(*names), "found"), names[1]), names[0], "left")
    return marked.withColumn(text, F.when(F.col(names[1]).isNull(), t).otherwise(_without(t, F.col(names[1])))).drop(*names)


#: code points of a piece of text in which places are looked up
PIECE = 1_000


def _without(text: Column, found: Column) -> Column:
    """``text`` with the matches (sorted by start) replaced; the work grows with the text and the matches, not with their product.

    Places in a text are found by counting code points from its start, so the text is first cut into pieces of one length."""
    def of(r: Column) -> Column:
        def step(upto: Column, i: Column) -> Column:
            s = r["found"][i]
            gap = F.struct(upto.alias("start"), s["start"].alias("stop"), s["kind"].alias("kind"))
            return F.struct(F.greatest(upto, s["stop"]).alias("state"), F.when(s["start"] >= upto, gap).alias("out"))

        gaps = F.filter(running(F.size(r["found"]), F.lit(0).cast("bigint"), step, "struct<start:bigint,stop:bigint,kind:string>"), lambda x: x.isNotNull())
        last = F.array_max(F.transform(r["found"], lambda s: s["stop"]))

        def cut(start: Column, stop: Column) -> Column:
            a, b = F.floor(start / PIECE).cast("int"), F.floor(stop / PIECE).cast("int")
            i, j = (start - a * PIECE).cast("int"), (stop - b * PIECE).cast("int")
            piece = lambda k: F.coalesce(F.get(r["pieces"], k), F.lit(""))
            middle = F.when(b - a > 1, F.array_join(F.slice(r["pieces"], a + 2, b - a - 1), "")).otherwise("")
            return F.when(a == b, piece(a).substr(i + 1, j - i)).otherwise(F.concat(piece(a).substr(i + 1, F.lit(PIECE)), middle, piece(b).substr(F.lit(1), j)))

        parts = F.transform(gaps, lambda g: F.concat(cut(g["start"], g["stop"]), F.lit("["), g["kind"], F.lit("]")))
        return F.concat(F.array_join(parts, ""), cut(last, r["size"]))

    row = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"), found.alias("found"), F.length(text).cast("bigint").alias("size"))
    return F.transform(F.array(row), of)[0]


def _duck(rules=RULES) -> str:
    one = []
    for i, r in enumerate(rules):
        p = f"$q${r.pattern}$q$"
        one.append(f"""SELECT doc_id, {i} AS ord, '{r.kind}' AS kind, start, start + length(whole[i]) AS stop FROM (
          SELECT doc_id, whole, part, i, (coalesce(list_sum(list_transform(between[1:i], lambda x: length(x))), 0)
            + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start
          FROM (SELECT *, unnest(generate_series(1, len(whole))) AS i FROM (SELECT doc_id, string_split_regex(t, {p}) AS between,
            regexp_extract_all(t, {p}) AS whole, regexp_extract_all(t, {p}, {r.group}) AS part FROM d WHERE regexp_matches(t, {p}))))
          WHERE length(part[i]) >= {r.least}""")
    text = "kind || ':' || start || ':' || stop"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(one)}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg({text}, ',' ORDER BY start, ord) FILTER (ord < {len(BASE)}), '') AS base, string_agg({text}, ',' ORDER BY start, ord) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""


ORACLE = _duck()
