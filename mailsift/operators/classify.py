"""Message classification: the whole enriched row for stored messages.

messages (uid, sender, subject, body, any other fields) ->
  serving text -> clean -> TF-IDF + engineered features -> linear score ->
  prediction + confidences -> sender / base domain -> trusted join ->
  display features -> rule reasons -> linear attributions + sentence
  [-> local surrogate].

One lazy plan, map-only but for the trusted-domain joins. Rows are never
grouped, so messages that share a uid (two mailboxes) stay apart.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.features import display_features
from ..functions.message import base_domain, registered_domain, sender_domain, serving_text
from ..functions.scores import LINEAR_SENTENCES, attribution_sentence, clamp_confidence, predicted_label, rule_reasons, sigmoid
from ..functions.text import clean_text, strip_ws
from .explain import attribution_array
from .models import LinearModel, featurise
from .tfidf import TfidfModel

# messages without a domain get one of so many keys that no domain has, so
# that they don't all meet in one task of a shuffled join
NO_DOMAIN_KEYS = 4096
# the messages of a domain are dealt over so many keys, each with a copy of the
# list, so that a domain with a large share of all messages is no single task
DEALT = 8


def trusted_domains(df: DataFrame, col: str | None = None, suffixes: Iterable[str] | None = None) -> DataFrame:
    """Distinct, stripped, lower-cased, non-empty domains from a `Domain` or
    `domain` column; no such column gives an empty list, not an error. With
    ``suffixes`` (rules of public suffixes), entries that are one are left out.

    The list is made here and kept (memory, then disk) for all plans and
    micro-batches that use it, so its true size, not that of the table it comes
    from, decides whether Spark broadcasts it
    (``spark.sql.autoBroadcastJoinThreshold``) or shuffles."""
    name = col or ("Domain" if "Domain" in df.columns else "domain" if "domain" in df.columns else None)
    if name is None:
        return df.sparkSession.createDataFrame([], "domain string")
    d = df.select(F.lower(strip_ws(F.col(name).cast("string"))).alias("domain"))
    if suffixes is not None:
        d = d.filter(registered_domain("domain", suffixes) != "")
    kept = d.filter(F.col("domain").isNotNull() & (F.col("domain") != "")).distinct().persist(StorageLevel.MEMORY_AND_DISK)
    kept.count()  # a kept table has its true size once it is there
    return kept


def mark_trusted(msgs: DataFrame, domains: DataFrame, sd: str = "sender_domain",
                 bd: str = "base_domain", out: str = "trusted_sender") -> DataFrame:
    """sender domain OR base domain in the list (distinct, as trusted_domains
    gives it): two equi-joins, as an OR condition would be a nested loop."""
    dealt = F.explode(F.array(*[F.lit(i) for i in range(DEALT)])).alias
    d1 = domains.select(F.col("domain").alias("_d1"), dealt("_p1"), F.lit(True).alias("_t1"))
    d2 = domains.select(F.col("domain").alias("_d2"), dealt("_p2"), F.lit(True).alias("_t2"))
    # matches no domain, so any number will do
    spread = F.concat(F.lit("\u0000"), (F.monotonically_increasing_id() % NO_DOMAIN_KEYS).cast("string"))
    key = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise(spread)
    j = (msgs.withColumn("_k1", key(sd)).withColumn("_k2", key(bd)).withColumn("_p", (F.monotonically_increasing_id() % DEALT).cast("int"))
         .join(d1, (F.col("_k1") == F.col("_d1")) & (F.col("_p") == F.col("_p1")), "left")
         .join(d2, (F.col("_k2") == F.col("_d2")) & (F.col("_p") == F.col("_p2")), "left"))
    flag = F.coalesce(F.col("_t1"), F.lit(False)) | F.coalesce(F.col("_t2"), F.lit(False))
    return j.withColumn(out, flag).drop("_k1", "_k2", "_p", "_d1", "_p1", "_t1", "_d2", "_p2", "_t2")


def classify_messages(tfidf: TfidfModel, model: LinearModel, msgs: DataFrame, domains: DataFrame,
                      toward_prediction: bool = True, keep=None, with_text: bool = False,
                      raw_features: bool = False, surrogate_samples: int | None = None, suffixes: Iterable[str] | None = None) -> DataFrame:
    """Enriched rows: every field of ``msgs`` (or those in ``keep``; an unknown
    name is an error), then the result columns, which replace fields of their
    names. ``with_text`` adds the cleaned serving text; ``raw_features`` takes
    the engineered features from the text before cleaning; ``surrogate_samples``
    adds surrogate_features and surrogate_summary from so many copies a message;
    ``suffixes`` (rules of public suffixes) makes base domains registered ones
    instead of the last two labels.
    """
    made = ("cleaned_text", "sender_domain", "base_domain", "pairs", "engineered", "margin", "prediction", "phishing_confidence",
            "legitimate_confidence", "trusted_sender", "engineered_features", "explanation_summary", "linear_features",
            "linear_summary", "surrogate_features", "surrogate_summary")
    missing = [c for c in (keep or ()) if c not in msgs.columns]
    if missing:
        raise ValueError(f"messages lack the columns {missing}")
    fields = [c for c in (msgs.columns if keep is None else dict.fromkeys(["uid", *keep])) if c not in made]
    base = msgs.select(*fields, serving_text("subject", "sender", "body").alias("_text"), sender_domain("sender").alias("sender_domain"))
    base = base.withColumn("cleaned_text", clean_text("_text")).withColumn(
        "base_domain", base_domain("sender_domain") if suffixes is None else registered_domain("sender_domain", suffixes))
    base = mark_trusted(base, domains)  # before the features, so that a list too large for a broadcast moves messages only
    carried = [*fields, "sender_domain", "base_domain", "trusted_sender"]
    want_text = with_text or surrogate_samples is not None
    feats = featurise(tfidf, base, text="cleaned_text", feature_text="_text" if raw_features else None,
                      keep=[*carried, *(["cleaned_text"] if want_text else [])], with_struct=True)
    scored = feats.withColumn("margin", model.margin()).withColumn("prediction", predicted_label("margin"))
    conf = sigmoid("margin") if model.has_proba else clamp_confidence("margin")
    scored = (scored.withColumn("phishing_confidence", conf)
                    .withColumn("legitimate_confidence", 1.0 - F.col("phishing_confidence")))
    scored = scored.select(*[c for c in scored.columns if c != "trusted_sender"], "trusted_sender")
    scored = scored.withColumn("engineered_features", display_features("engineered")).drop("engineered")
    scored = scored.withColumn("explanation_summary",
                               rule_reasons("prediction", "trusted_sender", "engineered_features"))
    scored = scored.withColumn("linear_features",
                               attribution_array(model, F.col("pairs"), F.col("prediction"),
                                                 K.ATTRIBUTION_TOP, toward_prediction)).drop("pairs")
    scored = scored.withColumn("linear_summary",
                               attribution_sentence("linear_features", "prediction", LINEAR_SENTENCES))
    if surrogate_samples is not None:
        from .surrogate import local_surrogate
        scored = local_surrogate(tfidf, model, scored, surrogate_samples)
    return scored if with_text else scored.drop("cleaned_text")


def by_prediction(classified: DataFrame, which: str = "all") -> DataFrame:
    """View filter: all / phishing / legitimate."""
    if which == "all":
        return classified
    return classified.filter(F.col("prediction") == which)


def inbox_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("uid"))


def new_messages(df: DataFrame, last_uid: int | None) -> DataFrame:
    """Strictly newer than the last seen uid (a poll never re-delivers it)."""
    return df if last_uid is None else df.filter(F.col("uid") > F.lit(int(last_uid)))
