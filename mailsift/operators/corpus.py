"""Corpus preparation: canonical shape, cleaning, union, dedupe, counts.

Canonical corpus schema: row_id STRING, source_rank INT, row_no BIGINT, source
STRING, text STRING, label STRING. ``row_no`` is a row's place in its source
and ``(source_rank, row_no)`` the concatenation order; both are assigned once at
ingestion and never re-derived after a shuffle. ``row_id`` is "<source_rank>:<row_no>",
so it is unique over the union even if every source counts from 0, and all
later keys (splits, folds, joins) rest on it; :func:`require_unique` checks it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import CLASSES, LEGITIMATE, PHISHING
from ..functions.message import compose_text
from ..functions.text import clean_text, normalise_label, strip_ws

CANONICAL = ("row_id", "source_rank", "row_no", "source", "text", "label")


@dataclass(frozen=True)
class SourceSpec:
    """How one raw corpus maps to ``text, label``.

    text_cols: one column used as is, or several parts each cleaned and
        joined by one blank (subject+body, sender+subject+body).
    label_col: raw label column, normalised; or ``constant_label``.
    keep_label: keep only rows of this class (after normalising).
    pre_clean: extra cleaning passes applied to a single text column before
        the final pass (the number of passes changes double blanks).
    """

    name: str
    rank: int
    text_cols: Sequence[str]
    label_col: str | None = None
    constant_label: str | None = None
    keep_label: str | None = None
    pre_clean: int = 0
    row_id_col: str = "row_id"


def row_key(rank, row_no):
    return F.concat_ws(":", rank.cast("string"), row_no.cast("string"))


def require_unique(df: DataFrame, key: str = "row_id") -> DataFrame:
    """``df`` itself; an error if two rows share the key. One aggregate."""
    again = df.groupBy(key).count().filter(F.col("count") > 1).limit(1).collect()
    if again:
        raise ValueError(f"{key} {again[0][0]!r} occurs {again[0][1]} times")
    return df


def evaluated(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` with ``cols`` made once a row, whatever filters them later.

    The optimizer moves a filter below the projection that makes its columns, and
    writes that out there for every use: two passes of cleaning a hundred times
    over, too much code to be compiled. It moves none below a generator's output."""
    others = [F.col(c) for c in df.columns if c not in cols]
    made = df.select(*others, F.explode_outer(F.array(F.struct(*cols))).alias("_made"))
    return made.select(*[F.col(f"_made.{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def has_text(cols) -> Column:
    """Any of the columns holds more than white space."""
    hit = F.lit(False)
    for c in cols:
        hit = hit | (strip_ws(F.coalesce(F.col(c), F.lit(""))) != "")
    return hit


def canonicalise(df: DataFrame, spec: SourceSpec) -> DataFrame:
    """Pick, rename, tag and finalise one source. A missing column is an error.

    Which rows stay is decided on the raw columns (cleaning only empties what
    is blank throughout), so the filter never repeats the cleaning."""
    needed = list(spec.text_cols) + ([spec.label_col] if spec.label_col else []) + [spec.row_id_col]
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"{spec.name}: missing columns {missing}")
    if spec.constant_label is None:
        label = normalise_label(spec.label_col)
        classes = CLASSES if spec.keep_label is None else (spec.keep_label,)
        df = df.filter(label.isin(*classes))
    else:
        label = F.lit(spec.constant_label)
        if spec.constant_label not in (CLASSES if spec.keep_label is None else (spec.keep_label,)):
            df = df.limit(0)
    df = df.filter(has_text(spec.text_cols))
    if len(spec.text_cols) == 1:
        text = F.col(spec.text_cols[0])
        for _ in range(spec.pre_clean):
            text = clean_text(text)
    else:
        text = compose_text(*[clean_text(c) for c in spec.text_cols])
    rank, row_no = F.lit(spec.rank).cast("int"), F.col(spec.row_id_col).cast("bigint")
    out = df.select(row_key(rank, row_no).alias("row_id"), rank.alias("source_rank"), row_no.alias("row_no"),
                    F.lit(spec.name).alias("source"), text.alias("text"), label.alias("label"))
    return out.withColumn("text", clean_text("text"))


def finalise(df: DataFrame) -> DataFrame:
    """One cleaning pass on text and label, keeping valid rows (F1). Validity
    is decided on the input (see valid_raw), so the filter repeats neither this
    cleaning nor, as the input is ``evaluated``, the one before."""
    out = valid_raw(evaluated(df, "text", "label"), "text", "label")
    return out.withColumn("text", clean_text("text")).withColumn("label", normalise_label("label"))


def valid_rows(df: DataFrame) -> DataFrame:
    return evaluated(df, "text", "label").filter((F.col("text") != "") & F.col("label").isin(*CLASSES))


def nonempty(df: DataFrame, col: str = "text") -> DataFrame:
    return df.filter(F.col(col) != "")


def combine(sources: Sequence[DataFrame]) -> DataFrame:
    """Bag union of canonical sources (order is carried by source_rank/row_id)."""
    out = sources[0].select(*CANONICAL)
    for s in sources[1:]:
        out = out.unionByName(s.select(*CANONICAL))
    return out


def dedupe_first(df: DataFrame) -> DataFrame:
    """One row per (text, label): the first in (source_rank, row_no) order.

    An aggregate on the text's SHA-256, not a window: partial aggregation
    collapses repeats inside each map task, so a text repeated a billion times
    ships one row per task and no key can overload one reducer. Sorting and
    hashing see 64 characters; the text rides in the aggregate's state.
    """
    order = F.struct("source_rank", "row_no")
    first = F.min_by(F.struct("row_id", "source_rank", "row_no", "source", "text"), order)
    return (df.groupBy(F.sha2("text", 256).alias("_h"), "label").agg(first.alias("_f"))
              .select("_f.row_id", "_f.source_rank", "_f.row_no", "_f.source", "_f.text", "label"))


def clean_passes(df: DataFrame, src: str, out: str, passes: int) -> DataFrame:
    """``passes`` cleaning passes, each its own projection (a pass references
    its input more than once, so nesting them in one expression would repeat
    the inner passes). Replaces ``src`` by ``out``."""
    others = [c for c in df.columns if c != src]
    cur = src
    for i in range(passes):
        nxt = f"_clean{i}"
        df = df.select(*others, clean_text(cur).alias(nxt))
        cur = nxt
    return df.withColumnRenamed(cur, out)


def valid_raw(df: DataFrame, text: str, label: str) -> DataFrame:
    """Rows that will be valid after cleaning, decided on the raw columns:
    cleaning only empties a text that is all whitespace (a header label is
    removed only when a word follows it), so this cheap predicate equals the
    filter on the cleaned text - and it is pushed to the scan instead of
    repeating the cleaning inside the filter."""
    return df.filter((strip_ws(F.coalesce(F.col(text), F.lit(""))) != "") & normalise_label(label).isin(*CLASSES))


def build_corpus(raw: DataFrame, passes: int = 2) -> DataFrame:
    """Raw single-text view (row_id, source_rank, row_no, source, raw_text, raw_label)
    -> cleaned, valid, deduplicated canonical corpus."""
    df = valid_raw(raw, "raw_text", "raw_label").select(
        "row_id", "source_rank", "row_no", "source", "raw_text", normalise_label("raw_label").alias("label"))
    df = clean_passes(df, "raw_text", "text", passes).select(*CANONICAL)
    return dedupe_first(df)


def label_index(col: str = "label"):
    """legitimate -> 0.0, phishing -> 1.0 (alphabetical class order)."""
    return F.when(F.col(col) == PHISHING, F.lit(1.0)).otherwise(F.lit(0.0))


# ----------------------------------------------------------------- counts

def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts per value including null, largest first."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count")) \
             .orderBy(F.desc("count"), F.asc_nulls_first("value"))


def class_distribution(df: DataFrame) -> DataFrame:
    """Both classes always present (0-filled), count, percentage (2 places), total."""
    domain = df.sparkSession.createDataFrame([(c,) for c in CLASSES], "class string")
    counts = df.groupBy(F.col("label").alias("class")).agg(F.count(F.lit(1)).alias("count"))
    j = domain.join(counts, "class", "left").select("class", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))
    total = F.sum("count").over(Window.partitionBy())  # two rows: the label domain
    pct = F.when(total > 0, F.round(F.col("count") * 100.0 / total, 2)).otherwise(F.lit(0.0))
    return j.select("class", "count", pct.alias("percentage"), total.alias("total"))


def source_breakdown(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "source")


def funnel(stages: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Row counts per stage and source, as one union of small aggregates."""
    parts = [df.groupBy("source").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("stage"), "source", "rows")
             for name, df in stages]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def require_two_classes(df: DataFrame, on_fail: str = "raise") -> bool:
    """True when both classes occur. One small action."""
    n = df.agg(F.count_distinct("label").alias("k")).first()["k"]
    if n < 2 and on_fail == "raise":
        raise ValueError("Training data only contains one class after cleaning.")
    return n >= 2


def cumulative_corpora(df: DataFrame, n_stages: int | None = None) -> DataFrame:
    """Growing prefixes of the source list in one pass: a row of source rank
    r belongs to every stage s >= r. Each stage is re-cleaned, not deduplicated.
    Stage numbers are 1-based counts of sources included."""
    if n_stages is None:
        n_stages = int(df.agg(F.max("source_rank")).first()[0]) + 1
    stage = F.explode(F.sequence(F.col("source_rank") + 1, F.lit(n_stages)))
    return finalise(df.select(stage.alias("stage"), *CANONICAL))
