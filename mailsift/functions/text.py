"""Text expressions (Column -> Column). All run JVM-side, no Python UDF.

Regex dialect notes (Java): the whitespace class below matches every
character Python's ``str.isspace`` accepts; the word class
``[\\p{L}\\p{N}_]`` stands in for Python's Unicode ``\\w``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import ENGLISH_STOP_WORDS, LABEL_SYNONYMS, NGRAM_MAX

WS = r"[\s\x0B\x1c-\x1f\x85\p{Z}]+"
WORD = r"[\p{L}\p{N}_]"
TOKEN = WORD + "{2,}"
HTML_TAG = r"<[^>]+>"
# header labels are removed only when glued to a word on the right
# ("subject:hello"), never in "Subject: hello" - the original boundary rule.
HEADER_LABELS = ("subject", "from", "body")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def collapse_ws(col: Column | str) -> Column:
    return F.regexp_replace(_c(col), WS, " ")


# the 29 characters Python's str.isspace() accepts (= the WS class above)
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")


def strip_ws(col: Column | str) -> Column:
    """Python ``str.strip()``: drop leading/trailing whitespace of any kind
    (a character-set trim, no regex)."""
    return F.trim(_c(col), F.lit(PY_WHITESPACE))


def clean_text(col: Column | str) -> Column:
    """null -> ''; whitespace runs -> one blank; drop glued header labels;
    strip; lower. One pass; apply it as many times as the pipeline does."""
    t = collapse_ws(F.coalesce(_c(col), F.lit("")))
    low = F.lower(t)
    hit = None
    stripped = t
    for label in HEADER_LABELS:
        stripped = F.regexp_replace(stripped, rf"(?iu)(?<!{WORD}){label}:(?={WORD})", " ")
        # detection only: a literal-first pattern (Boyer-Moore search) for a
        # label glued to a word; "Subject: x" never triggers the exact pass
        h = low.rlike(rf"{label}:(?={WORD})")
        hit = h if hit is None else (hit | h)
    # the label regexes only run on texts that contain a label at all
    t = F.when(hit, stripped).otherwise(t)
    # after the collapse only plain blanks can sit at the ends
    return F.lower(F.trim(t))


def normalise_label(col: Column | str) -> Column:
    """null -> ''; strip; lower; map known spellings to the two classes;
    anything else passes through unchanged (and is later dropped)."""
    v = F.lower(strip_ws(F.coalesce(_c(col).cast("string"), F.lit(""))))
    out = None
    for raw, cls in LABEL_SYNONYMS.items():
        out = (F.when(v == raw, F.lit(cls)) if out is None
               else out.when(v == raw, F.lit(cls)))
    return out.otherwise(v)


def strip_html(col: Column | str) -> Column:
    """Each tag -> blank, whitespace runs -> blank, strip. Script/style text
    and entities are kept, as in the original fetcher."""
    t = F.regexp_replace(F.coalesce(_c(col), F.lit("")), HTML_TAG, " ")
    return F.trim(collapse_ws(t))


def tokens(col: Column | str) -> Column:
    """Lower-case, then maximal runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(TOKEN), 0)


def drop_stop_words(arr: Column, stop_words: Iterable[str] = ENGLISH_STOP_WORDS) -> Column:
    # more than ten literals: the optimizer turns isin into a hash-set lookup
    stops = sorted(set(stop_words))
    if not stops:
        return arr
    return F.filter(arr, lambda x: ~x.isin(stops))


def ngrams(arr: Column, n_max: int = NGRAM_MAX) -> Column:
    """Unigrams followed by 2..n_max-grams of adjacent tokens, joined by a blank.

    Built from shifted slices with zip_with: lambdas only see their own
    arguments (a lambda that indexes an outer array expression would
    re-evaluate it per element)."""
    out, prev = arr, arr
    for n in range(2, n_max + 1):
        width = F.greatest(F.size(arr) - (n - 1), F.lit(0))
        cur = F.zip_with(F.slice(prev, 1, width), F.slice(arr, n, width),
                         lambda a, b: F.concat(a, F.lit(" "), b))
        out, prev = F.concat(out, cur), cur
    return out


def analyse(col: Column | str, stop_words: Iterable[str] = ENGLISH_STOP_WORDS,
            n_max: int = NGRAM_MAX) -> Column:
    """Token -> stop-word filter -> n-grams: the terms a document contributes.
    (As one expression; :func:`with_term_counts` evaluates it step by step.)"""
    return ngrams(drop_stop_words(tokens(col), stop_words), n_max)


def with_terms(df: DataFrame, text: str, out: str, stop_words: Iterable[str] = ENGLISH_STOP_WORDS, n_max: int = NGRAM_MAX,
               keep: Iterable[str] = ()) -> DataFrame:
    """*keep and ``out`` array<string>: the terms of :func:`analyse`, evaluated step by step."""
    d = df.select(*keep, drop_stop_words(tokens(text), stop_words).alias("_tok"))
    return d.select(*keep, F.coalesce(ngrams(F.col("_tok"), n_max), F.array().cast("array<string>")).alias(out))


def with_term_counts(df: DataFrame, text: str, out: str = "tc",
                     stop_words: Iterable[str] = ENGLISH_STOP_WORDS, n_max: int = NGRAM_MAX,
                     keep: Iterable[str] | None = None) -> DataFrame:
    """Adds ``out`` = array<struct<term string, tf bigint>> sorted by term.

    Counted inside the row (sort + run lengths), so term frequencies need no
    shuffle: a document's terms never leave its task. Each intermediate array
    is its own projection, so it is computed once per row.
    """
    keep = list(df.columns if keep is None else keep)
    k = [c for c in keep if c not in (out,)]
    d = df.select(*k, drop_stop_words(tokens(text), stop_words).alias("_tok"))
    d = d.select(*k, F.sort_array(ngrams(F.col("_tok"), n_max)).alias("_s"))   # natural order, no comparator lambda
    # the array shifted right by one (same length, so zip_with never pads)
    prev = F.slice(F.concat(F.array(F.lit(None).cast("string")), F.col("_s")), 1, F.size("_s"))
    d = d.select(*k, "_s", F.zip_with("_s", prev, lambda a, b: b.isNull() | (a != b)).alias("_st"))
    d = d.select(*k, F.size("_s").alias("_n"),
                 F.filter(F.zip_with("_s", "_st", lambda t, b: F.when(b, t)), lambda x: x.isNotNull()).alias("_u"),
                 F.filter(F.transform("_st", lambda b, i: F.when(b, i).otherwise(-1)), lambda x: x >= 0).alias("_i"))
    nxt = F.slice(F.concat(F.col("_i"), F.array(F.col("_n"))), 2, F.size("_i"))   # next run start
    tf = F.zip_with(nxt, "_i", lambda a, b: (a - b).cast("bigint"))
    d = d.select(*k, "_u", tf.alias("_tf"))
    return d.select(*k, F.zip_with("_u", "_tf", lambda t, c: F.struct(t.alias("term"), c.alias("tf"))).alias(out))
