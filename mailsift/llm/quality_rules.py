"""Quality rules, line first: lines are judged and removed one by one, and a
document that loses too much of its text is rejected.

DataFrame functions only. Arrays that a lambda looks into are bound as lambda
variables (``_with``), because an outer array expression inside a lambda would
be evaluated again for every element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
FEWEST_WORDS, MOST_REPEATED = 20, 30  # words; per cent of the words

# Line rules. A line fails on any of them.
MOST_SYMBOLS = 0.10  # punctuation: share of symbol characters
MOST_SHOUTS = 0.06  # punctuation: share of doubled exclamation and question marks
SEPARATORS = r"(?:[|»›•·].*){3}"  # navigation: a row of items between separators
SHOUTING = r"\p{Lu}\P{Lu}*\p{Lu}\P{Lu}*\p{Lu}\P{Lu}*\p{Lu}\P{Lu}*\p{Lu}"  # with no lower-case letter at all
MOST_STUTTER = 20  # per cent of the words: words followed by themselves
BOILERPLATE = (r"(?i)all rights reserved|privacy policy|terms of (use|service)|cookie (policy|settings)|accept (all )?cookies"
               r"|enable javascript|lorem ipsum|click here|subscribe to our|sign up for our|skip to content|back to top")
#: Share of a document's characters that removed lines may hold.
MOST_LOST = 0.30


def _with(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def lines_of(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))


def repeated_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that the text holds twice or more."""
    def windows(h):
        return F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))

    def covered(w):  # sort (hash, place): equal neighbours are repeats; then the union of their places
        ranked = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = _with(ranked, lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                                                 | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    counted = _with(_with(hashes, windows), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long"))
                    .otherwise(covered(w)))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(counted)


def line_fails(s: Column) -> Column:
    """Whether a line fails a punctuation, navigation or boilerplate rule."""
    def share(pattern: str) -> Column:
        return (F.length(s) - F.length(F.regexp_replace(s, pattern, ""))) / F.length(s)

    stutter = F.regexp_count(s, F.lit(r"(?<!\S)(\S+)(?=\s+\1(?!\S))"))
    return (s.rlike(SEPARATORS) | (share(SYMBOLS + "+") > MOST_SYMBOLS) | (share("[!?]{2,}") > MOST_SHOUTS)
            | (s.rlike(SHOUTING) & ~s.rlike(r"\p{Ll}")) | s.rlike(BOILERPLATE)
            | _with(stutter, lambda n: (n > 1) & (100 * n > MOST_STUTTER * F.regexp_count(s, F.lit(r"\S+")))))


def quality_rules(docs: DataFrame, text_col: str = "text", most_lost: float = MOST_LOST, keep: list[str] | None = None,
                  clean_text: bool = True) -> DataFrame:
    """``docs`` (the columns ``keep``, default all) with the counts n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed,
    lines_removed long, lost double (share of the characters of lines with a
    word), kept boolean and, if ``clean_text``, clean_text (the lines that pass).

    These columns replace columns of ``docs`` by their names. A null or empty
    text has no words and fails; its clean text is null or empty. Every row gives a row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lines_removed", "lost", "kept",
            "clean_text"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    long = lambda c: c.cast("long")
    chars = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, s: n + F.length(s))
    base = docs.select(
        *kept, F.col(text_col).alias("__text"),
        _with(words_of(text), lambda w: F.struct(
            long(F.size(w)).alias("n_words"), chars(w).alias("word_chars"), repeated_words(w).alias("n_repeat_words"))).alias("__w"),
        long(F.length(text) - F.length(F.regexp_replace(text, SYMBOLS + "+", ""))).alias("n_symbols"),
        _with(lines_of(text), lambda a: F.struct(
            long(F.size(a) - F.size(F.array_distinct(a))).alias("n_dup_lines"), chars(a).alias("chars"),
            _with(F.filter(a, line_fails), lambda bad: F.struct(long(F.size(bad)).alias("n"), chars(bad).alias("chars"))).alias("bad"),
        )).alias("__l"))
    n, repeat = F.col("__w.n_words"), F.col("__w.n_repeat_words")
    failed = (n < FEWEST_WORDS) | (100 * repeat > MOST_REPEATED * n)
    lost = F.when(F.col("__l.chars") > 0, F.col("__l.bad.chars") / F.col("__l.chars")).otherwise(0.0)
    out = base.select(*kept, "__text", n.alias("n_words"), F.col("__w.word_chars").alias("word_chars"), "n_symbols",
                      F.col("__l.n_dup_lines").alias("n_dup_lines"), repeat.alias("n_repeat_words"), failed.alias("base_failed"),
                      F.col("__l.bad.n").alias("lines_removed"), lost.alias("lost"))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= most_lost))
    if clean_text:
        passing = F.filter(F.split("__text", "\n", -1), lambda s: ~(s.rlike(r"[^\x20\x09-\x0D]") & line_fails(s)))
        out = out.withColumn("clean_text", F.array_join(passing, "\n"))
    return out.drop("__text")


#: The same in DuckDB SQL, over ``documents``.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - {WINDOW - 2}), lambda i: array_to_string(ws[i:i + {WINDOW - 1}], ' '))) AS g,
               unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW}),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, sum(least({WINDOW}, i - last)) AS n FROM (
          SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -{WINDOW}) AS last FROM twice) GROUP BY doc_id),
cut AS (SELECT doc_id, s, regexp_extract_all(s, '[^\x20\x09-\x0D]+') AS ws FROM (SELECT doc_id, unnest(ls) AS s FROM w)),
line AS (SELECT doc_id, s, ws, list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1]) AS again FROM cut),
judged AS (SELECT doc_id, s, regexp_matches(s, '{SEPARATORS}')
      OR (length(s) - length(regexp_replace(s, '{SYMBOLS}+', '', 'g'))) / length(s) > {MOST_SYMBOLS}
      OR (length(s) - length(regexp_replace(s, '[!?]{{2,}}', '', 'g'))) / length(s) > {MOST_SHOUTS}
      OR (regexp_matches(s, '{SHOUTING}') AND NOT regexp_matches(s, '\p{{Ll}}'))
      OR regexp_matches(s, '{BOILERPLATE}')
      OR (len(again) > 1 AND 100 * len(again) > {MOST_STUTTER} * len(ws)) AS bad FROM line),
lost AS (SELECT doc_id, coalesce(sum(length(s)) FILTER (bad), 0) / sum(length(s)) AS lost,
                count(*) FILTER (bad) AS lines_removed FROM judged GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
       CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
       CAST(length(t) - length(regexp_replace(t, '{SYMBOLS}+', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
       (len(ws) < {FEWEST_WORDS} OR 100 * coalesce(rep.n, 0) > {MOST_REPEATED} * len(ws)) AS base_failed,
       CAST(coalesce(lines_removed, 0) AS BIGINT) AS lines_removed,
       NOT (len(ws) < {FEWEST_WORDS} OR 100 * coalesce(rep.n, 0) > {MOST_REPEATED} * len(ws)) AND coalesce(lost, 0) <= {MOST_LOST} AS kept
FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)
"""
