"""Line-first cleaning: rules for punctuation, navigation and boilerplate judge each line, failing lines go, and documents
that lose too much text are rejected.  DataFrame functions only; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
# fixed values: line rules
#: a line of running text closes with one of these, perhaps quoted or in brackets
PUNCTUATION = r"""[.!?:;\x{2026}\x{3002}\x{FF01}\x{FF1F}]["'\x{201D}\x{2019}\x{BB})\]*#$%&|<>!]*[\x20\x09-\x0D]*\z"""
#: three separators of a menu
NAVIGATION = r"(?:[|\x{BB}\x{203A}\x{2022}][^|\x{BB}\x{203A}\x{2022}]*){3}"
BOILERPLATE = (r"(?i)\b(?:all rights reserved|terms (?:of|and) (?:use|service|conditions)|privacy policy|cookie policy|we use cookies|enable javascript"
               r"|subscribe to our newsletter|click here to|sign in to|log in to|share this (?:post|article|page)|licensed under|copyright (?:\(c\)|[0-9]{4})|lorem ipsum)")
#: up to so many repeated windows are looked up one by one, more are found by sorting
FEW = 48


def measures(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: key, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Windows are told apart by 64-bit hashes of their three words. With few repeated windows each position is looked up among
    them, else (hash, position) pairs are sorted; either way the covered words are counted in order of position. A null or blank text has no words and fails."""
    t = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    t = t.withColumn("words", F.expr(f"filter(split(coalesce(text, ''), r'{SPACE}+'), w -> w != '')"))
    t = t.withColumn("lines", F.expr(r"filter(split(coalesce(text, ''), '\n'), l -> l rlike r'[^\x20\x09-\x0D]')"))
    t = t.select(
        "key", "text", F.expr("cast(size(words) AS bigint) AS n_words"),
        F.expr("cast(length(concat_ws('', words)) AS bigint) AS word_chars"),
        F.expr(f"cast(coalesce(length(text) - length(translate(text, '{SYMBOLS}', '')), 0) AS bigint) AS n_symbols"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) AS bigint) AS n_dup_lines"),
        F.expr("CASE WHEN size(words) < 3 THEN cast(array() AS array<bigint>) "
               "ELSE transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) END AS h"))
    # windows in order of hash, where the values that come again are found
    t = t.withColumn("s", F.expr("CASE WHEN size(array_distinct(h)) = size(h) THEN cast(array() AS array<bigint>) ELSE sort_array(h) END"))
    t = t.withColumn("again", F.expr("array_distinct(filter(s, (x, i) -> i > 0 AND s[i - 1] = x))"))
    t = t.withColumn("z", F.expr(f"CASE WHEN size(again) > {FEW} THEN array_sort(transform(h, (x, i) -> struct(x AS x, i AS i))) END"))
    t = t.withColumn("at", F.expr(
        f"CASE WHEN size(again) = 0 THEN cast(array() AS array<int>) "
        f"WHEN size(again) <= {FEW} THEN filter(sequence(0, size(h) - 1), i -> array_contains(again, h[i])) "
        "ELSE sort_array(transform(filter(z, (e, k) -> (k > 0 AND z[k - 1].x = e.x) OR (k < size(z) - 1 AND z[k + 1].x = e.x)), e -> e.i)) END"))
    covered = ("aggregate(at, struct(0 AS upto, 0L AS total), (a, p) -> struct(p + 3 AS upto, "
               "a.total + (p + 3 - greatest(p, a.upto)) AS total), a -> a.total)")
    return t.select("key", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.expr(f"{covered} AS n_repeat_words")).withColumn(
        "base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def clean(df: DataFrame, *, key: str = "doc_id", text: str = "text", most_lost: float = 0.5) -> DataFrame:
    """One row for each row: key, clean_text, the measures, n_lines, n_lines_removed, chars_lost (a share) and kept.

    Lines with words are judged one by one: a line fails if it does not close with punctuation, if it holds three menu
    separators, or if it has a phrase of legal or site boilerplate. ``clean_text`` is the other lines in order; blank lines
    go. ``kept`` is false when base_failed, or when over ``most_lost`` of the characters of lines with words went. A null text
    has a null clean_text and is not kept. Repeated rows and null keys stay as they are; other columns are not read."""
    t = measures(df, key=key, text=text)
    t = t.withColumn("lines", F.expr(r"filter(split(coalesce(text, ''), '\n'), l -> l rlike r'[^\x20\x09-\x0D]')"))
    t = t.withColumn("good", F.filter("lines", lambda line: line.rlike(PUNCTUATION) & ~line.rlike(NAVIGATION) & ~line.rlike(BOILERPLATE)))
    chars = "aggregate({}, 0L, (a, l) -> a + length(l))"
    t = t.withColumn("all_chars", F.expr(chars.format("lines"))).withColumn("lost", F.col("all_chars") - F.expr(chars.format("good")))
    return t.select(
        F.col("key").alias(key), F.when(F.col("text").isNotNull(), F.concat_ws("\n", "good")).alias("clean_text"),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size("good")).cast("bigint").alias("n_lines_removed"),
        F.col("lost").alias("chars_removed"),
        (~F.col("base_failed") & (F.col("lost") <= F.lit(most_lost) * F.col("all_chars"))).alias("kept"))


#: the same for DuckDB, over documents
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, text FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS words,
      list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT doc_id, i, words[i] || chr(1) || words[i + 1] || chr(1) || words[i + 2] AS g
      FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM p) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
g AS (SELECT *, list_filter(lines, lambda l: regexp_matches(l, $q${PUNCTUATION}$q$) AND NOT regexp_matches(l, $q${NAVIGATION}$q$)
      AND NOT regexp_matches(l, $q${BOILERPLATE}$q$)) AS good FROM w),
m AS (SELECT g.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
      (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
      (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
      len(lines)::BIGINT AS n_lines, (len(lines) - len(good))::BIGINT AS n_lines_removed,
      length(array_to_string(lines, ''))::BIGINT AS all_chars, length(array_to_string(good, ''))::BIGINT AS good_chars
      FROM g LEFT JOIN cov ON g.doc_id = cov.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  n_lines, n_lines_removed, all_chars - good_chars AS chars_removed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND all_chars - good_chars <= 0.5 * all_chars) AS kept
FROM m"""
