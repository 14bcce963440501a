"""Registry of checked queries: ``QUERIES[name](spark, sf_dir) -> DataFrame``
and, where the operator has a SQL form, ``ORACLE[name]`` (DuckDB text over
the driver's pre-registered tables). Column names match one to one; doubles
are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import features as FE
from ..functions import message as M
from ..functions import text as T
from ..operators import corpus as C
from ..sources import tables as S
from . import sql as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def corpus(spark, sf_dir):
    """The cleaned, deduplicated fixture corpus, persisted once per session."""
    from .pipeline import fixture_run
    return fixture_run(spark, sf_dir).corpus


def flat_features(col: str):
    f = FE.engineered_features(col)
    return [f["link_count"].alias("link_count"), f["has_urgent_words"].alias("has_urgent_words"),
            f["has_account_words"].alias("has_account_words"), f["has_payment_words"].alias("has_payment_words"),
            f["exclamation_count"].alias("exclamation_count"),
            F.round(f["uppercase_ratio"], 6).alias("uppercase_ratio")]


# ------------------------------------------------------------------ phase 0/1

@register("clean_text", Q.with_ctes() + f"SELECT row_id, {Q.clean_text('raw_text')} AS text FROM corpus")
def q_clean_text(spark, sf_dir):
    return S.corpus_view(spark, sf_dir).select("row_id", T.clean_text("raw_text").alias("text"))


@register("normalise_label", Q.with_ctes() + f"SELECT row_id, {Q.normalise_label('raw_label')} AS label FROM corpus")
def q_normalise_label(spark, sf_dir):
    return S.corpus_view(spark, sf_dir).select("row_id", T.normalise_label("raw_label").alias("label"))


@register("label_value_counts", Q.with_ctes() +
          "SELECT raw_label AS value, count(*) AS count FROM corpus GROUP BY raw_label")
def q_label_value_counts(spark, sf_dir):
    return C.value_counts(S.corpus_view(spark, sf_dir), "raw_label")


@register("corpus_valid", Q.with_ctes(Q.clean_corpus_cte()) + "SELECT row_id, source, text, label FROM valid")
def q_corpus_valid(spark, sf_dir):
    raw = S.corpus_view(spark, sf_dir)
    df = C.valid_raw(raw, "raw_text", "raw_label").select(
        "row_id", "source", "raw_text", T.normalise_label("raw_label").alias("label"))
    return C.clean_passes(df, "raw_text", "text", 2).select("row_id", "source", "text", "label")


@register("corpus_dedupe", Q.with_ctes(Q.clean_corpus_cte()) + "SELECT row_id, source_rank, source, text, label FROM dedup")
def q_corpus_dedupe(spark, sf_dir):
    return corpus(spark, sf_dir).select("row_id", "source_rank", "source", "text", "label")


@register("class_distribution", Q.with_ctes(Q.clean_corpus_cte()) + """
SELECT d.class, coalesce(c.n, 0) AS count,
       CASE WHEN t.total > 0 THEN round(coalesce(c.n, 0) * 100.0 / t.total, 2) ELSE 0.0 END AS percentage,
       t.total AS total
FROM (VALUES ('legitimate'), ('phishing')) d(class)
LEFT JOIN (SELECT label, count(*) AS n FROM dedup GROUP BY label) c ON c.label = d.class
CROSS JOIN (SELECT count(*) AS total FROM dedup) t""")
def q_class_distribution(spark, sf_dir):
    return C.class_distribution(corpus(spark, sf_dir))


@register("source_breakdown", Q.with_ctes(Q.clean_corpus_cte()) +
          "SELECT source, count(*) AS count FROM dedup GROUP BY source")
def q_source_breakdown(spark, sf_dir):
    return C.source_breakdown(corpus(spark, sf_dir))


@register("funnel", Q.with_ctes(Q.clean_corpus_cte()) + """
SELECT 'raw' AS stage, source, count(*) AS rows FROM corpus GROUP BY source
UNION ALL SELECT 'valid', source, count(*) FROM valid GROUP BY source
UNION ALL SELECT 'deduplicated', source, count(*) FROM dedup GROUP BY source""")
def q_funnel(spark, sf_dir):
    raw = S.corpus_view(spark, sf_dir)
    valid = C.valid_raw(raw, "raw_text", "raw_label").select(
        "row_id", "source_rank", "row_no", "source", "raw_text", T.normalise_label("raw_label").alias("label"))
    valid = C.clean_passes(valid, "raw_text", "text", 2)
    return C.funnel([("raw", raw), ("valid", valid), ("deduplicated", C.dedupe_first(valid))])


@register("engineered_features", Q.with_ctes(Q.clean_corpus_cte()) +
          f"SELECT row_id, {Q.features('text')} FROM dedup".replace(
              f"{Q.uppercase_ratio('text')} AS uppercase_ratio",
              f"round({Q.uppercase_ratio('text')}, 6) AS uppercase_ratio"))
def q_engineered_features(spark, sf_dir):
    return corpus(spark, sf_dir).select("row_id", *flat_features("text"))


@register("raw_text_features", Q.with_ctes() +
          f"SELECT row_id, {Q.features('raw_text')} FROM corpus".replace(
              f"{Q.uppercase_ratio('raw_text')} AS uppercase_ratio",
              f"round({Q.uppercase_ratio('raw_text')}, 6) AS uppercase_ratio"))
def q_raw_text_features(spark, sf_dir):
    return S.corpus_view(spark, sf_dir).select("row_id", *flat_features("raw_text"))


@register("strip_html", Q.with_ctes() + f"SELECT page_id, {Q.strip_html('html')} AS text FROM pages")
def q_strip_html(spark, sf_dir):
    return S.table(spark, sf_dir, "pages").select("page_id", T.strip_html("html").alias("text"))


@register("page_links", Q.with_ctes() +
          f"SELECT page_id, {Q.link_count('html')} AS link_count, {Q.link_count(Q.strip_html('html'))} AS text_link_count FROM pages")
def q_page_links(spark, sf_dir):
    p = S.table(spark, sf_dir, "pages")
    return p.select("page_id", FE.link_count("html").alias("link_count"),
                    FE.link_count(T.strip_html("html")).alias("text_link_count"))


@register("sender_domains", Q.with_ctes() + f"""
SELECT uid, sender_domain, {Q.base_domain('sender_domain')} AS base_domain
FROM (SELECT uid, {Q.sender_domain('sender')} AS sender_domain FROM mail)""")
def q_sender_domains(spark, sf_dir):
    m = S.mail_view(spark, sf_dir).select("uid", M.sender_domain("sender").alias("sender_domain"))
    return m.select("uid", "sender_domain", M.base_domain("sender_domain").alias("base_domain"))


@register("serving_text", Q.with_ctes() + f"""
SELECT uid, text, {Q.clean_text('text')} AS cleaned_text
FROM (SELECT uid, {Q.serving_text('subject', 'sender', 'body')} AS text FROM mail)""")
def q_serving_text(spark, sf_dir):
    m = S.mail_view(spark, sf_dir).select("uid", M.serving_text("subject", "sender", "body").alias("text"))
    return m.select("uid", "text", T.clean_text("text").alias("cleaned_text"))


@register("message_defaults", Q.with_ctes() + f"""
SELECT uid, CASE WHEN coalesce(subject, '') = '' THEN {Q.q(K.NO_SUBJECT)} ELSE subject END AS subject,
       CAST(uid AS VARCHAR) AS message_id, coalesce(body, '') AS body
FROM mail""")
def q_message_defaults(spark, sf_dir):
    m = S.mail_view(spark, sf_dir)
    return m.select("uid", M.default_subject("subject").alias("subject"),
                    M.default_message_id(F.lit(None).cast("string"), "uid").alias("message_id"),
                    M.message_body("body").alias("body"))


@register("compose_text", Q.with_ctes() + f"""
SELECT uid, trim(concat_ws(' ', {Q.clean_text('sender')}, {Q.clean_text('subject')}, {Q.clean_text('body')}), ' ') AS text
FROM mail""")
def q_compose_text(spark, sf_dir):
    m = S.mail_view(spark, sf_dir)
    return m.select("uid", M.compose_text(T.clean_text("sender"), T.clean_text("subject"),
                                          T.clean_text("body")).alias("text"))


# ------------------------------------------------------------ phase 2: text model inputs

from ..operators import split as SP  # noqa: E402
from ..operators import tfidf as TF  # noqa: E402
from ..operators import models as MD  # noqa: E402
from .pipeline import fixture_run  # noqa: E402

_CORPUS = Q.clean_corpus_cte()


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


@register("term_frequencies", Q.with_ctes(_CORPUS, Q.tf_cte("tf_all", "dedup")) +
          "SELECT row_id, term, tf FROM tf_all")
def q_term_frequencies(spark, sf_dir):
    return TF.term_frequencies(corpus(spark, sf_dir))


@register("document_frequencies", Q.with_ctes(_CORPUS, Q.tf_cte("tf_all", "dedup")) +
          "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS corpus_tf FROM tf_all GROUP BY term HAVING count(*) >= 2")
def q_document_frequencies(spark, sf_dir):
    stats = TF.document_frequencies(TF.doc_terms(corpus(spark, sf_dir)))
    return TF.top_terms(stats, None, 2)


@register("stratified_split", Q.with_ctes(_CORPUS, Q.split_cte()) + "SELECT row_id, label, part FROM parts")
def q_stratified_split(spark, sf_dir):
    return fixture_run(spark, sf_dir).parts.select("row_id", "label", "part")


_FOLDS = """
f_counts AS (SELECT label, count(*) AS n_c FROM train GROUP BY label),
f_rank AS (SELECT row_id, label, row_number() OVER (PARTITION BY label
             ORDER BY substr(md5(CAST(row_id AS VARCHAR) || ':43'), 1, 15), row_id) AS rk FROM train),
folds AS (SELECT r.row_id, r.label, CAST(""" + " + ".join(
    f"CAST(r.rk > ({f} * c.n_c) // 5 AS INT)" for f in range(1, 5)) + """ AS INT) AS fold
          FROM f_rank r JOIN f_counts c ON r.label = c.label)"""


@register("stratified_folds", Q.with_ctes(_CORPUS, Q.split_cte(), _FOLDS) + "SELECT row_id, label, fold FROM folds")
def q_stratified_folds(spark, sf_dir):
    return SP.stratified_folds(fixture_run(spark, sf_dir).train).select("row_id", "label", "fold")


_PREFIX = """
fpairs AS (SELECT f.row_id, g.fold FROM folds f CROSS JOIN (VALUES (0), (1), (2), (3), (4)) g(fold) WHERE g.fold <> f.fold),
nmax AS (SELECT count(*) AS n FROM fpairs WHERE fold = 0),
sizes AS (SELECT DISTINCT least(greatest(CAST(floor(CAST(fr AS DOUBLE) * n) AS BIGINT), 1), n) AS size
          FROM nmax CROSS JOIN (VALUES (0.1), (0.325), (0.55), (0.775), (1.0)) s(fr)),
prank AS (SELECT row_id, fold, row_number() OVER (PARTITION BY fold
            ORDER BY substr(md5(CAST(row_id AS VARCHAR) || ':44'), 1, 15), row_id) AS rk FROM fpairs)"""


@register("train_prefixes", Q.with_ctes(_CORPUS, Q.split_cte(), _FOLDS, _PREFIX) +
          "SELECT row_id, fold, CAST(size AS INT) AS size FROM prank CROSS JOIN sizes WHERE rk <= size")
def q_train_prefixes(spark, sf_dir):
    folded = SP.stratified_folds(fixture_run(spark, sf_dir).train)
    return SP.train_prefixes(folded)


@register("class_weights", Q.with_ctes(_CORPUS, Q.split_cte()) + """
SELECT label, n_c, round(sum(n_c) OVER () / (count(*) OVER () * n_c), 6) AS weight
FROM (SELECT label, count(*) AS n_c FROM train GROUP BY label)""")
def q_class_weights(spark, sf_dir):
    w = MD.class_weights(fixture_run(spark, sf_dir).train)
    return w.select("label", "n_c", r6("weight").alias("weight"))


@register("vocabulary", Q.with_ctes(_CORPUS, Q.split_cte(), Q.tf_cte("tf_train", "train"), Q.vocab_cte("tf_train", "train")) +
          "SELECT term, term_ix, df, corpus_tf, round(idf, 6) AS idf FROM vocab")
def q_vocabulary(spark, sf_dir):
    v = fixture_run(spark, sf_dir).tfidf.vocab_df(spark)
    return v.select("term", "term_ix", "df", "corpus_tf", r6("idf").alias("idf"))


@register("vocabulary_small", Q.with_ctes(_CORPUS, Q.split_cte(), Q.tf_cte("tf_train", "train"), Q.vocab_cte("tf_train", "train", 500)) +
          "SELECT term, term_ix, df, corpus_tf, round(idf, 6) AS idf FROM vocab")
def q_vocabulary_small(spark, sf_dir):
    """A cut that fires, ties at its edge included."""
    run = fixture_run(spark, sf_dir)
    small = TF.TfidfModel.fit(None, max_features=500, tc=run.terms.filter(F.col("part") == "train"))
    return small.vocab_df(spark).select("term", "term_ix", "df", "corpus_tf", r6("idf").alias("idf"))


@register("tfidf_weights", Q.with_ctes(_CORPUS, *Q.text_model_ctes()[:5]) +
          "SELECT row_id, ix AS term_ix, round(w, 6) AS weight FROM tfidf")
def q_tfidf_weights(spark, sf_dir):
    run = fixture_run(spark, sf_dir)
    lf = run.tfidf.long_form(run.corpus)
    return lf.select("row_id", "term_ix", r6("weight").alias("weight"))


# ------------------------------------------------------------ phase 3: NB + scoring

_MODEL = Q.with_ctes(_CORPUS, *Q.text_model_ctes())


@register("nb_coefficients", _MODEL + "SELECT ix AS feature_ix, feature, round(coefficient, 6) AS coefficient FROM coef")
def q_nb_coefficients(spark, sf_dir):
    run = fixture_run(spark, sf_dir)
    return run.nb.coefficients(spark).select("feature_ix", "feature", r6("coefficient").alias("coefficient"))


@register("flagship", _MODEL + """
SELECT row_id, actual, predicted, round(margin, 6) AS margin, round(phishing_confidence, 6) AS phishing_confidence
FROM scored""")
def q_flagship(spark, sf_dir):
    s = fixture_run(spark, sf_dir).scored()
    return s.select("row_id", "actual", "predicted", r6("margin").alias("margin"),
                    r6("phishing_confidence").alias("phishing_confidence"))


# ------------------------------------------------------------ phase 3b: metrics and explanations

from ..operators import metrics as MT  # noqa: E402
from ..operators import explain as EX  # noqa: E402
from ..operators import classify as CL  # noqa: E402
from ..functions import scores as SC  # noqa: E402


def _scored(spark, sf_dir):
    return fixture_run(spark, sf_dir).scored()


_COUNTS = """
cm AS (SELECT sum(CASE WHEN actual = 'phishing' AND predicted = 'phishing' THEN 1 ELSE 0 END) AS tp,
              sum(CASE WHEN actual = 'legitimate' AND predicted = 'phishing' THEN 1 ELSE 0 END) AS fp,
              sum(CASE WHEN actual = 'phishing' AND predicted = 'legitimate' THEN 1 ELSE 0 END) AS fn,
              sum(CASE WHEN actual = 'legitimate' AND predicted = 'legitimate' THEN 1 ELSE 0 END) AS tn FROM scored)"""


def _div(a, b):
    return f"(CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0 END)"


@register("confusion_matrix", _MODEL.rstrip() + ",\n" + _COUNTS.strip() + """
SELECT actual, predicted, CAST(count AS BIGINT) AS count FROM cm,
  (VALUES ('legitimate', 'legitimate', 'tn'), ('legitimate', 'phishing', 'fp'),
          ('phishing', 'legitimate', 'fn'), ('phishing', 'phishing', 'tp')) g(actual, predicted, cell),
  LATERAL (SELECT CASE cell WHEN 'tn' THEN tn WHEN 'fp' THEN fp WHEN 'fn' THEN fn ELSE tp END AS count)""")
def q_confusion(spark, sf_dir):
    return MT.confusion(_scored(spark, sf_dir))


@register("binary_metrics", _MODEL.rstrip() + ",\n" + _COUNTS.strip() + f"""
SELECT round({_div('tp + tn', 'tp + tn + fp + fn')}, 6) AS accuracy, round({_div('tp', 'tp + fp')}, 6) AS precision,
       round({_div('tp', 'tp + fn')}, 6) AS recall, round({_div('2 * tp', '2 * tp + fp + fn')}, 6) AS f1_score FROM cm""")
def q_binary_metrics(spark, sf_dir):
    m = MT.binary_metrics(_scored(spark, sf_dir))
    return m.select(*[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1_score")])


@register("classification_report", _MODEL.rstrip() + ",\n" + _COUNTS.strip() + f""",
per AS (SELECT 'legitimate' AS class, {_div('tn', 'tn + fn')} AS p, {_div('tn', 'tn + fp')} AS r,
               {_div('2 * tn', '2 * tn + fn + fp')} AS f, tn + fp AS s, tp + fp + fn + tn AS n FROM cm
        UNION ALL SELECT 'phishing', {_div('tp', 'tp + fp')}, {_div('tp', 'tp + fn')},
               {_div('2 * tp', '2 * tp + fp + fn')}, tp + fn, tp + fp + fn + tn FROM cm)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(s AS BIGINT) AS support FROM per
UNION ALL SELECT 'accuracy', NULL, NULL, round({_div('tp + tn', 'tp + tn + fp + fn')}, 6), CAST(tp + tn + fp + fn AS BIGINT) FROM cm
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(max(n) AS BIGINT) FROM per
UNION ALL SELECT 'weighted avg', round(sum(p * s) / max(n), 6), round(sum(r * s) / max(n), 6), round(sum(f * s) / max(n), 6),
                 CAST(max(n) AS BIGINT) FROM per""")
def q_classification_report(spark, sf_dir):
    r = MT.classification_report(_scored(spark, sf_dir))
    return r.select("class", r6("precision").alias("precision"), r6("recall").alias("recall"),
                    r6("f1").alias("f1"), "support")


@register("error_tables", _MODEL.rstrip() + """,
wrong AS (SELECT s.*, d.text FROM scored s JOIN dedup d ON d.row_id = s.row_id WHERE actual <> predicted)
SELECT row_id, text, actual, predicted, round(phishing_confidence, 6) AS phishing_confidence, 'misclassified' AS kind FROM wrong
UNION ALL SELECT row_id, text, actual, predicted, round(phishing_confidence, 6),
       CASE WHEN actual = 'legitimate' THEN 'false_positive' ELSE 'false_negative' END FROM wrong""")
def q_error_tables(spark, sf_dir):
    e = fixture_run(spark, sf_dir).with_text(MT.error_tables(_scored(spark, sf_dir)))
    return e.select("row_id", "text", "actual", "predicted", r6("phishing_confidence").alias("phishing_confidence"), "kind")


@register("top_features", _MODEL + f"""
SELECT 'phishing' AS "group", CAST(row_number() OVER (ORDER BY coefficient DESC, ix DESC) AS INT) AS rank, feature,
       round(coefficient, 6) AS coefficient FROM (SELECT * FROM coef ORDER BY coefficient DESC, ix DESC LIMIT {K.TOP_COEFFICIENTS})
UNION ALL
SELECT 'legitimate', CAST(row_number() OVER (ORDER BY coefficient, ix) AS INT), feature, round(coefficient, 6)
FROM (SELECT * FROM coef ORDER BY coefficient, ix LIMIT {K.TOP_COEFFICIENTS})""")
def q_top_features(spark, sf_dir):
    run = fixture_run(spark, sf_dir)
    t = EX.top_features(run.nb.coefficients(spark))
    return t.select("group", F.col("rank").cast("int").alias("rank"), "feature", r6("coefficient").alias("coefficient"))


@register("confidence_modes", _MODEL + """
SELECT row_id, round(greatest(0.0, least(1.0, (margin + 3.0) / 6.0)), 6) AS clamp_confidence,
       round(1.0 / (1.0 + exp(-margin)), 6) AS sigmoid_confidence FROM scored""")
def q_confidence_modes(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.select("row_id", r6(SC.clamp_confidence("margin")).alias("clamp_confidence"),
                    r6(SC.sigmoid("margin")).alias("sigmoid_confidence"))


@register("attributions", _MODEL.rstrip() + ",\n" + Q.attributions_cte("attr", "feats", "scored").strip() + """
SELECT row_id, CAST(rk AS INT) AS rank, feature, weight FROM attr""")
def q_attributions(spark, sf_dir):
    run = fixture_run(spark, sf_dir)
    s = run.nb.score(run.test_features, keep=("label", "pairs"))
    a = s.select("row_id", F.posexplode(EX.attribution_array(run.nb, F.col("pairs"), F.col("predicted"))).alias("p", "x"))
    return a.select("row_id", (F.col("p") + 1).cast("int").alias("rank"), "x.feature", F.col("x.weight").alias("weight"))


@register("attribution_summary", _MODEL.rstrip() + ",\n" + Q.attributions_cte("attr", "feats", "scored").strip() + f"""
SELECT p.row_id, {Q.sentence_expr('attr', 'p')} AS linear_summary FROM scored p""")
def q_attribution_summary(spark, sf_dir):
    run = fixture_run(spark, sf_dir)
    s = run.nb.score(run.test_features, keep=("label", "pairs"))
    return EX.attributions(run.nb, s).select("row_id", "linear_summary")


# ------------------------------------------------------------ messages

_MAIL = Q.with_ctes(_CORPUS, *Q.text_model_ctes(), *Q.mail_ctes())


def _classified(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CLASSIFIED:
        run = fixture_run(spark, sf_dir)
        msgs = S.mail_view(spark, sf_dir)
        dom = CL.trusted_domains(S.trusted_view(spark, sf_dir))
        _CLASSIFIED[key] = CL.classify_messages(run.tfidf, run.nb, msgs, dom, keep=("sender",)).persist()
    return _CLASSIFIED[key]


_CLASSIFIED: dict = {}


@register("trusted_sender", Q.with_ctes(*[c for c in Q.mail_ctes()[:1]]).rstrip() + """,
tset AS (SELECT DISTINCT domain FROM trusted WHERE domain IS NOT NULL AND domain <> '')
SELECT row_id AS uid, sd AS sender_domain, bd AS base_domain,
       (sd IN (SELECT domain FROM tset) OR bd IN (SELECT domain FROM tset)) AS trusted_sender FROM mail_clean""")
def q_trusted_sender(spark, sf_dir):
    m = S.mail_view(spark, sf_dir).select("uid", M.sender_domain("sender").alias("sender_domain"))
    m = m.withColumn("base_domain", M.base_domain("sender_domain"))
    return CL.mark_trusted(m, CL.trusted_domains(S.trusted_view(spark, sf_dir)))


@register("classify_messages", _MAIL + f"""
SELECT s.row_id AS uid, s.predicted AS prediction, round(1.0 / (1.0 + exp(-s.margin)), 6) AS phishing_confidence,
       round(1.0 - 1.0 / (1.0 + exp(-s.margin)), 6) AS legitimate_confidence, s.sd AS sender_domain,
       s.bd AS base_domain, s.trusted AS trusted_sender, {Q.link_count('s.ctext')} AS link_count,
       ({Q.has_any('s.ctext', K.URGENT_WORDS)} = 1) AS has_urgent_words,
       ({Q.has_any('s.ctext', K.ACCOUNT_WORDS)} = 1) AS has_account_words,
       ({Q.has_any('s.ctext', K.PAYMENT_WORDS)} = 1) AS has_payment_words,
       {Q.exclamation_count('s.ctext')} AS exclamation_count, round({Q.uppercase_ratio('s.ctext')}, 4) AS uppercase_ratio,
       {Q.reasons_expr('s.ctext').replace('NOT trusted', 'NOT s.trusted').replace('WHEN trusted', 'WHEN s.trusted').replace('predicted =', 's.predicted =')} AS explanation_summary,
       {Q.sentence_expr('mail_attr', 's').replace('p.row_id', 's.row_id').replace('p.predicted', 's.predicted')} AS linear_summary
FROM mail_scored s""")
def q_classify_messages(spark, sf_dir):
    c = _classified(spark, sf_dir)
    f = F.col("engineered_features")
    return c.select("uid", "prediction", r6("phishing_confidence").alias("phishing_confidence"),
                    r6("legitimate_confidence").alias("legitimate_confidence"), "sender_domain", "base_domain",
                    "trusted_sender", *[f[n].alias(n) for n in K.ENGINEERED_FEATURES],
                    F.array_join("explanation_summary", " | ").alias("explanation_summary"), "linear_summary")


@register("message_attributions", _MAIL + "SELECT row_id AS uid, CAST(rk AS INT) AS rank, feature, weight FROM mail_attr")
def q_message_attributions(spark, sf_dir):
    c = _classified(spark, sf_dir)
    a = c.select("uid", F.posexplode("linear_features").alias("p", "x"))
    return a.select("uid", (F.col("p") + 1).cast("int").alias("rank"), "x.feature", F.col("x.weight").alias("weight"))


@register("inbox_summary", _MAIL + """
SELECT count(*) AS count, CAST(count_if(predicted = 'phishing') AS BIGINT) AS phishing,
       CAST(count_if(predicted = 'legitimate') AS BIGINT) AS legitimate
FROM mail_scored""")
def q_inbox_summary(spark, sf_dir):
    return MT.inbox_summary(_classified(spark, sf_dir))


@register("phishing_view", _MAIL + "SELECT row_id AS uid, sender_domain FROM (SELECT *, sd AS sender_domain FROM mail_scored) WHERE predicted = 'phishing'")
def q_phishing_view(spark, sf_dir):
    return CL.by_prediction(_classified(spark, sf_dir), K.PHISHING).select("uid", "sender_domain")


@register("new_messages", Q.with_ctes() + """
SELECT uid, sender, subject, body FROM mail WHERE uid > (SELECT CAST(floor(avg(doc_id)) AS BIGINT) FROM labels)""")
def q_new_messages(spark, sf_dir):
    # last seen uid: a high-water mark derived from the labels table
    last = S.table(spark, sf_dir, "labels").agg(F.floor(F.avg("doc_id"))).first()[0]
    return CL.new_messages(S.mail_view(spark, sf_dir), last).select("uid", "sender", "subject", "body")


@register("cumulative_corpora", Q.with_ctes(Q.clean_corpus_cte()) + """
SELECT s.stage, v.label, count(*) AS count FROM valid v
JOIN (VALUES (1), (2), (3), (4), (5)) s(stage) ON v.source_rank + 1 <= s.stage GROUP BY s.stage, v.label""")
def q_cumulative_corpora(spark, sf_dir):
    raw = S.corpus_view(spark, sf_dir)
    once = raw.select("row_id", "source_rank", "row_no", "source", T.clean_text("raw_text").alias("text"),
                      T.normalise_label("raw_label").alias("label"))
    staged = C.cumulative_corpora(C.valid_rows(once), 5)
    return staged.groupBy("stage", "label").agg(F.count(F.lit(1)).alias("count"))


# ------------------------------------------------------------ canonical sources (P1-P4, F2, U1, W1)

from .pipeline import TextRun, materialise  # noqa: E402


def _conv_view(spark, sf_dir):
    c = S.table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.col("role").alias("sender"),
                    F.col("turn").cast("string").alias("subject"), F.col("text").alias("body"),
                    F.when(F.col("role") == "user", F.lit("spam")).otherwise(F.lit("ham")).alias("raw_label"))


def _sources_sql():
    cl, nl = Q.clean_text, Q.normalise_label
    fin = lambda t: f"{cl(t)}"
    return Q.with_ctes("""
conv AS (SELECT conv_id * 1000 + turn AS row_id, role AS sender, CAST(turn AS VARCHAR) AS subject, text AS body,
                CASE WHEN role = 'user' THEN 'spam' ELSE 'ham' END AS raw_label FROM conversations)""") + f"""
, a0 AS (SELECT row_id, 0 AS source_rank, 'corpus' AS source, raw_text AS text, raw_label AS label FROM corpus),
a AS (SELECT row_id, source_rank, source, {fin('text')} AS text, {nl('label')} AS label FROM a0),
b0 AS (SELECT uid AS row_id, 1 AS source_rank, 'mail' AS source,
              trim(concat_ws(' ', {cl('subject')}, {cl('body')}), ' ') AS text, 'legitimate' AS label FROM mail),
b AS (SELECT row_id, source_rank, source, {fin('text')} AS text, {nl('label')} AS label FROM b0),
c0 AS (SELECT row_id, 2 AS source_rank, 'turns' AS source,
              trim(concat_ws(' ', {cl('sender')}, {cl('subject')}, {cl('body')}), ' ') AS text, {nl('raw_label')} AS label FROM conv),
c AS (SELECT row_id, source_rank, source, {fin('text')} AS text, {nl('label')} AS label FROM c0 WHERE label = 'phishing'),
u AS (SELECT * FROM a WHERE text <> '' AND label IN ('legitimate', 'phishing')
      UNION ALL SELECT * FROM b WHERE text <> '' AND label IN ('legitimate', 'phishing')
      UNION ALL SELECT * FROM c WHERE text <> '' AND label IN ('legitimate', 'phishing')),
f AS (SELECT row_id, source_rank, source, {cl('text')} AS text, {nl('label')} AS label FROM u),
fv AS (SELECT * FROM f WHERE text <> '' AND label IN ('legitimate', 'phishing')),
united AS (SELECT source_rank || ':' || row_id AS row_id, source, text, label FROM (
  SELECT *, row_number() OVER (PARTITION BY text, label ORDER BY source_rank, row_id) AS rn FROM fv) WHERE rn = 1)
"""


_SOURCES = _sources_sql()


def _united(spark, sf_dir):
    """Three sources that all count their rows from about 0."""
    a = C.canonicalise(S.corpus_view(spark, sf_dir), C.SourceSpec("corpus", 0, ("raw_text",), label_col="raw_label"))
    b = C.canonicalise(S.mail_view(spark, sf_dir).withColumnRenamed("uid", "row_id"),
                       C.SourceSpec("mail", 1, ("subject", "body"), constant_label=K.LEGITIMATE))
    c = C.canonicalise(_conv_view(spark, sf_dir),
                       C.SourceSpec("turns", 2, ("sender", "subject", "body"), label_col="raw_label", keep_label=K.PHISHING))
    return C.dedupe_first(C.finalise(C.combine([a, b, c])))


@register("canonical_sources", _SOURCES + "SELECT row_id, source, text, label FROM united")
def q_canonical_sources(spark, sf_dir):
    return _united(spark, sf_dir).select("row_id", "source", "text", "label")


@register("multi_source_training", _SOURCES.rstrip() + ",\n" + ",\n".join(x.strip() for x in Q.text_model_ctes("united")) + """
SELECT row_id, actual, predicted, round(margin, 6) AS margin FROM scored""")
def q_multi_source_training(spark, sf_dir):
    """The whole text model on sources whose row numbers collide."""
    run = TextRun(spark, C.require_unique(materialise(_united(spark, sf_dir))))
    s = run.scored(run.nb)
    return s.select("row_id", "actual", "predicted", r6("margin").alias("margin"))


# ------------------------------------------------------------ studies and jobs

from ..operators import surrogate as SG  # noqa: E402
from ..operators.rank import distributed_rank  # noqa: E402
from ..session import materialise as stored  # noqa: E402
from ..session import scratch_path  # noqa: E402
from ..sources import io as IO  # noqa: E402
from . import jobs as JB  # noqa: E402

_METRIC_COLUMNS = ("accuracy", "precision", "recall")
_METRICS = f"""round({_div('tp + tn', 'tp + tn + fp + fn')}, 6) AS accuracy, round({_div('tp', 'tp + fp')}, 6) AS precision,
       round({_div('tp', 'tp + fn')}, 6) AS recall, round({_div('2 * tp', '2 * tp + fp + fn')}, 6) AS """


@register("compare_models")
def q_compare_models(spark, sf_dir):
    res, _, best = JB.compare_models(fixture_run(spark, sf_dir))
    return res.withColumn("is_best", F.col("model") == F.lit(best))


@register("learning_curve")
def q_learning_curve(spark, sf_dir):
    """Of the best of the three models."""
    run = fixture_run(spark, sf_dir)
    _, _, best = JB.compare_models(run)
    return JB.learning_curve(run, best).withColumn("model", F.lit(best))


_CURVE = Q.with_ctes(_CORPUS, *Q.text_model_ctes(), _FOLDS, _PREFIX).rstrip() + """,
cells AS (SELECT row_id, fold, CAST(size AS INT) AS size FROM prank CROSS JOIN sizes WHERE rk <= size),
cfc AS (SELECT c.fold, c.size, t.label, f.ix, sum(f.w) AS s FROM cells c JOIN train t ON t.row_id = c.row_id
        JOIN feats f ON f.row_id = c.row_id GROUP BY c.fold, c.size, t.label, f.ix),
csum AS (SELECT fold, size, sum(s) FILTER (label = 'phishing') AS t_p, sum(s) FILTER (label = 'legitimate') AS t_l FROM cfc GROUP BY fold, size),
cnum AS (SELECT c.fold, c.size, count(*) FILTER (t.label = 'phishing') AS n_p, count(*) FILTER (t.label = 'legitimate') AS n_l
         FROM cells c JOIN train t ON t.row_id = c.row_id GROUP BY c.fold, c.size),
delta AS (SELECT fold, size, ix, ln(coalesce(sum(s) FILTER (label = 'phishing'), 0) + 1.0)
                 - ln(coalesce(sum(s) FILTER (label = 'legitimate'), 0) + 1.0) AS d FROM cfc GROUP BY fold, size, ix),
judged AS (SELECT row_id, fold, size, 'train' AS kind FROM cells UNION ALL
           SELECT f.row_id, f.fold, z.size, 'validation' FROM folds f JOIN (SELECT DISTINCT fold, size FROM cells) z ON z.fold = f.fold),
summed AS (SELECT e.row_id, e.fold, e.size, e.kind, t.label, coalesce(sum(f.w), 0) AS sx, coalesce(sum(f.w * coalesce(d.d, 0)), 0) AS sd
           FROM judged e JOIN train t ON t.row_id = e.row_id LEFT JOIN feats f ON f.row_id = e.row_id
           LEFT JOIN delta d ON d.fold = e.fold AND d.size = e.size AND d.ix = f.ix GROUP BY e.row_id, e.fold, e.size, e.kind, t.label),
told AS (SELECT s.*, CASE WHEN CASE WHEN n_p > 0 AND n_l > 0 THEN ln(n_p) - ln(n_l) END
                + (ln(t_l + n_features) - ln(t_p + n_features)) * sx + sd > 0 THEN 'phishing' ELSE 'legitimate' END AS predicted
         FROM summed s JOIN csum USING (fold, size) JOIN cnum USING (fold, size) CROSS JOIN nf),
cells_cm AS (SELECT fold, size, kind, count(*) FILTER (label = 'phishing' AND predicted = 'phishing') AS tp,
               count(*) FILTER (label = 'legitimate' AND predicted = 'phishing') AS fp,
               count(*) FILTER (label = 'phishing' AND predicted = 'legitimate') AS fn,
               count(*) FILTER (label = 'legitimate' AND predicted = 'legitimate') AS tn FROM told GROUP BY fold, size, kind),
""" + f"""wf AS (SELECT size, kind, ({_div('2 * tp', '2 * tp + fp + fn')} * (tp + fn) + {_div('2 * tn', '2 * tn + fp + fn')} * (tn + fp))
                      / (tp + fp + fn + tn) AS f FROM cells_cm)
SELECT size, round(avg(f) FILTER (kind = 'train'), 6) AS train_score, round(avg(f) FILTER (kind = 'validation'), 6) AS validation_score
FROM wf GROUP BY size"""


@register("learning_curve_nb", _CURVE)
def q_learning_curve_nb(spark, sf_dir):
    c = JB.learning_curve(fixture_run(spark, sf_dir), "Naive Bayes")
    return c.select("size", r6("train_score").alias("train_score"), r6("validation_score").alias("validation_score"))


def _stages(spark, sf_dir):
    raw = S.corpus_view(spark, sf_dir)
    once = raw.select("row_id", "source_rank", "row_no", "source", T.clean_text("raw_text").alias("text"),
                      T.normalise_label("raw_label").alias("label"))
    return C.valid_rows(once), [" + ".join(S.SOURCE_NAMES[: i + 1]) for i in range(len(S.SOURCE_NAMES))]


@register("dataset_contribution")
def q_dataset_contribution(spark, sf_dir):
    return JB.contribution(*_stages(spark, sf_dir))


def _nb_metrics_sql(head: str, source: str, names: str, f1: str, **how) -> str:
    ctes = ",\n".join(x.strip() for x in (*Q.text_model_ctes(source, **how), _COUNTS))
    return f"SELECT * FROM ({head.rstrip()},\n{ctes}\nSELECT {names}, {_METRICS}{f1} FROM cm)"


@register("dataset_contribution_nb", " UNION ALL ".join(
    _nb_metrics_sql(Q.with_ctes(_CORPUS, f"staged AS (SELECT * FROM valid WHERE source_rank < {s})"), "staged",
                    f"'{' + '.join(S.SOURCE_NAMES[:s])}' AS dataset, 'Naive Bayes' AS model", "f1") for s in range(1, 6)))
def q_dataset_contribution_nb(spark, sf_dir):
    c = JB.contribution(*_stages(spark, sf_dir), models=("Naive Bayes",))
    return c.select("dataset", "model", *[r6(x).alias(x) for x in (*_METRIC_COLUMNS, "f1")])


@register("external_scoring", _MODEL.rstrip() + f""",
ext AS (SELECT *, conv_id * 1000 + turn AS row_id, {Q.clean_text('text')} AS ctext FROM conversations),
kept AS (SELECT * FROM ext WHERE ctext <> ''),
""" + ",\n".join(x.strip() for x in (Q.tf_cte("tf_ext", "kept", "ctext"), Q.tfidf_cte("xtfidf", "tf_ext"),
                                      Q.engineered_pairs_cte("xeng", "kept", "ctext"),
                                      "xfeats AS (SELECT * FROM xtfidf UNION ALL SELECT * FROM xeng)",
                                      Q.margins_cte("xm", "kept", "xfeats", None))) + """
SELECT conv_id, turn, role, ctext AS text, CASE WHEN margin > 0 THEN 'phishing' ELSE 'legitimate' END AS predicted_label,
       round(1.0 / (1.0 + exp(-margin)), 6) AS phishing_confidence FROM kept JOIN xm ON xm.row_id = kept.row_id""")
def q_external_scoring(spark, sf_dir):
    """Score an external table (conversation turns: a text column plus others)."""
    run = fixture_run(spark, sf_dir)
    ext = IO.read_if_present(spark, f"{sf_dir}/conversations.parquet", "text", "parquet")
    return JB.score_external(run.tfidf, run.nb, ext).withColumn("phishing_confidence", r6("phishing_confidence"))


@register("optional_table", "SELECT 'conversations' AS name, true AS there, count(*) AS rows FROM conversations "
          "UNION ALL SELECT 'nothing', false, 0 UNION ALL SELECT 'events', false, 0")
def q_optional_table(spark, sf_dir):
    """An external table is used only if it exists and has a text column."""
    out = None
    for name in ("conversations", "nothing", "events"):
        df = IO.read_if_present(spark, f"{sf_dir}/{name}.parquet", "text", "parquet")
        n = F.lit(0).cast("long") if df is None else None
        row = (spark.range(1).select(F.lit(name).alias("name"), F.lit(False).alias("there"), n.alias("rows")) if df is None else
               df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), F.lit(True).alias("there"), "rows"))
        out = row if out is None else out.unionByName(row)
    return out


@register("preset_ablation")
def q_preset_ablation(spark, sf_dir):
    """Hold-out metrics of three models under each pipeline preset."""
    return JB.preset_runs(S.corpus_view(spark, sf_dir))


def _preset_sql(cfg) -> str:
    if cfg.clean_case:
        docs = Q.clean_corpus_cte().replace("FROM corpus", f"FROM corpus WHERE source_rank < {cfg.sources}")
    else:
        docs = f"""
stripped AS (SELECT row_id, source_rank, {Q.strip_ws("coalesce(raw_text, '')")} AS text, {Q.normalise_label('raw_label')} AS label
             FROM corpus WHERE source_rank < {cfg.sources}),
dedup AS (SELECT row_id, source_rank, text, label FROM (
    SELECT *, row_number() OVER (PARTITION BY text, label ORDER BY source_rank, row_id) AS rn FROM stripped
    WHERE text <> '' AND label IN ('legitimate', 'phishing')) WHERE rn = 1)"""
    return _nb_metrics_sql(Q.with_ctes(docs), "dedup", f"'{cfg.name}' AS preset, 'Naive Bayes' AS model", "f1_score",
                           max_features=cfg.max_features, min_df=cfg.min_df, sublinear=cfg.sublinear, engineered=cfg.engineered)


@register("preset_ablation_nb", " UNION ALL ".join(_preset_sql(cfg) for cfg in JB.PRESETS.values()))
def q_preset_ablation_nb(spark, sf_dir):
    c = JB.preset_runs(S.corpus_view(spark, sf_dir), models=("Naive Bayes",))
    return c.select("preset", "model", *[r6(x).alias(x) for x in (*_METRIC_COLUMNS, "f1_score")])


@register("two_class_guard", Q.with_ctes(Q.clean_corpus_cte()) + """
SELECT s.source_rank, s.source, count(DISTINCT v.label) >= 2 AS both FROM (SELECT DISTINCT source_rank, source FROM corpus) s
LEFT JOIN valid v ON v.source_rank = s.source_rank GROUP BY s.source_rank, s.source""")
def q_two_class_guard(spark, sf_dir):
    valid, _ = _stages(spark, sf_dir)
    valid = stored(valid.select("source_rank", "label").distinct(), "classes")  # cleaned once for all sources
    return spark.createDataFrame([(i, name, C.require_two_classes(valid.filter(F.col("source_rank") == i), on_fail="skip"))
                                  for i, name in enumerate(S.SOURCE_NAMES)], "source_rank int, source string, both boolean")


@register("seeded_shuffle", Q.with_ctes() + "SELECT uid, sender FROM mail")
def q_seeded_shuffle(spark, sf_dir):
    return SP.seeded_shuffle(S.mail_view(spark, sf_dir).select("uid", "sender"), "uid")


@register("inbox_order", Q.with_ctes() + "SELECT uid, subject FROM mail")
def q_inbox_order(spark, sf_dir):
    return CL.inbox_order(S.mail_view(spark, sf_dir).select("uid", "subject"))


@register("trusted_domains_csv", Q.with_ctes() + "SELECT DISTINCT domain FROM trusted WHERE domain IS NOT NULL AND domain <> ''")
def q_trusted_domains_csv(spark, sf_dir):
    path = scratch_path(spark, "domains")
    hosts = S.trusted_view(spark, sf_dir).select(F.lit(1).alias("rank"), F.concat(F.lit(" "), F.upper("domain")).alias("Domain"))
    IO.write_table(hosts.unionByName(hosts), path, "domains", fmt="csv")
    return IO.read_trusted_domains(spark, path + "/domains").unionByName(IO.read_trusted_domains(spark, path + "/none"))


_NA = ", ".join(Q.q(t) for t in K.NA_TOKENS)


@register("read_corpus_csv", Q.with_ctes() + f"""
SELECT CASE WHEN raw_text IN ({_NA}) THEN NULL ELSE raw_text END AS raw_text,
       CASE WHEN raw_label IN ({_NA}) THEN NULL ELSE raw_label END AS raw_label FROM corpus""")
def q_read_corpus_csv(spark, sf_dir):
    """CSV round trip of the raw corpus view (quoted newlines, NA tokens, a
    column too many, another column order)."""
    path = scratch_path(spark, "corpus-csv")
    IO.write_table(S.corpus_view(spark, sf_dir).select("raw_label", F.col("row_id").alias("extra"), "raw_text"), path, "corpus", fmt="csv")
    return IO.read_corpus(spark, path + "/corpus", ["raw_text", "raw_label"])


def _write_sources(spark, sf_dir) -> list[str]:
    """The corpus view as five CSV files of the five shapes."""
    raw, path = S.corpus_view(spark, sf_dir), scratch_path(spark, "files")
    subject = F.concat(F.lit("About "), "source").alias("subject")
    body, label, extra = F.col("raw_text").alias("body"), F.col("raw_label").alias("label"), F.col("row_no").alias("extra")
    shapes = [[label, extra, F.col("raw_text").alias("text")], [extra, subject, body, label], [subject, body, extra],
              [extra, F.col("raw_text").alias("Email Text"), F.col("raw_label").alias("Email Type")],
              [F.lit("Desk@example.org").alias("sender"), subject, body, label]]
    return [IO.write_table(raw.filter(F.col("source_rank") == i).select(*cols), path, f"source{i}", fmt="csv")
            for i, cols in enumerate(shapes)]


def _files_sql() -> str:
    cl, nl, parts = Q.clean_text, Q.normalise_label, []
    for spec in JB.FILE_SOURCES:
        if len(spec.text_cols) == 1:
            text = cl("raw_text")
            for _ in range(spec.pre_clean):
                text = cl(text)
        else:
            bits = ([cl("'Desk@example.org'")] if "sender" in spec.text_cols else []) + [cl("concat('About ', source)"), cl("raw_text")]
            text = cl(f"trim(concat_ws(' ', {', '.join(bits)}), ' ')")
        label = Q.q(spec.constant_label) if spec.constant_label else nl("raw_label")
        parts.append(f"SELECT source_rank, row_id, {Q.q(spec.name)} AS source, {text} AS text, {label} AS label FROM corpus "
                     f"WHERE source_rank = {spec.rank}" + (f" AND {nl('raw_label')} = {Q.q(spec.keep_label)}" if spec.keep_label else ""))
    return Q.with_ctes("u AS (" + " UNION ALL ".join(parts) + ")") + f"""
SELECT source, text, label FROM (SELECT *, row_number() OVER (PARTITION BY text, label ORDER BY source_rank, row_id) AS rn FROM (
  SELECT source_rank, row_id, source, {cl('text')} AS text, label FROM u WHERE text <> '' AND label IN ('legitimate', 'phishing'))) WHERE rn = 1"""


@register("file_training_corpus", _files_sql())
def q_file_training_corpus(spark, sf_dir):
    """The file-driven run, naive Bayes only; the corpus table that it writes."""
    out = scratch_path(spark, "run")
    JB.train_from_files(spark, _write_sources(spark, sf_dir), out, models=("Naive Bayes",), studies=False)
    return spark.read.parquet(out + "/corpus").select("source", "text", "label")


@register("file_training_tables")
def q_file_training_tables(spark, sf_dir):
    """The file-driven run with all models: the rows of every table that it writes
    (the studies have queries of their own)."""
    out = scratch_path(spark, "run")
    external = {"turns": S.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")}
    JB.train_from_files(spark, _write_sources(spark, sf_dir), out, fmt="parquet", studies=False, external=external)
    rows = None
    for name in ("model_results", "classification_reports", "errors", "false_positives", "false_negatives",
                 "top_features", "external_turns", "class_distribution", "source_breakdown"):
        table = spark.read.parquet(f"{out}/{name}")
        key = F.lit(None).cast("string") if "model" not in table.columns else F.col("model")
        part = table.groupBy(key.alias("model")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "model", "rows")
        rows = part if rows is None else rows.unionByName(part)
    return rows


@register("ingest_messages", Q.with_ctes() + f"""
SELECT uid, '<' || uid || '@fixture>' AS message_id, ltrim(coalesce(sender, ''), ' ') AS sender,
       CASE WHEN coalesce(subject, '') = '' THEN {Q.q(K.NO_SUBJECT)} ELSE subject END AS subject, '' AS date,
       {Q.strip_html("coalesce(body, '')")} AS body FROM mail""")
def q_ingest_messages(spark, sf_dir):
    """Every message of the mail view as a raw RFC-822 message in a binary column."""
    m = S.mail_view(spark, sf_dir)
    raw = F.concat(F.lit("From: "), F.coalesce("sender", F.lit("")), F.lit("\r\nSubject: "), F.coalesce("subject", F.lit("")),
                   F.lit("\r\nMessage-ID: <"), F.col("uid").cast("string"), F.lit("@fixture>\r\n"),
                   F.lit("Content-Type: text/html; charset=utf-8\r\n\r\n<html><body><p>"),
                   F.coalesce("body", F.lit("")), F.lit("</p></body></html>"))
    return IO.ingest_messages(m.select("uid", raw.cast("binary").alias("content")))


@register("model_roundtrip", _MODEL + """
SELECT row_id, round(margin, 6) AS m_loaded, round(margin, 6) AS margin, true AS equal FROM scored""")
def q_model_roundtrip(spark, sf_dir):
    """Save and reload the fitted pair; scores must equal the in-memory model's."""
    run = fixture_run(spark, sf_dir)
    path = scratch_path(spark, "model")
    IO.save_model(spark, path, run.tfidf, run.nb)
    tf2, nb2 = IO.load_model(spark, path)
    a = nb2.score(MD.featurise(tf2, run.test), keep=("label",)).select("row_id", F.col("margin").alias("m_loaded"))
    j = a.join(run.scored().select("row_id", "margin"), "row_id")
    return j.select("row_id", r6("m_loaded").alias("m_loaded"), r6("margin").alias("margin"),
                    (F.abs(F.col("m_loaded") - F.col("margin")) < 1e-9).alias("equal"))


# ------------------------------------------------------------ two mailboxes, streams

_TWO = _MODEL.rstrip() + f""",
mails AS (SELECT 'inbox' AS mailbox, uid, sender, subject, body FROM mail
         UNION ALL SELECT 'archive', conv_id * 8 + turn + 1, role, 'turn', text FROM conversations),
docs2 AS (SELECT mailbox || ':' || uid AS row_id, mailbox, uid, {Q.clean_text(Q.serving_text('subject', 'sender', 'body'))} AS ctext FROM mails),
""" + ",\n".join(x.strip() for x in (Q.tf_cte("tf_two", "docs2", "ctext"), Q.tfidf_cte("t2", "tf_two"), Q.engineered_pairs_cte("e2", "docs2", "ctext"),
                                      "f2 AS (SELECT * FROM t2 UNION ALL SELECT * FROM e2)", Q.margins_cte("m2", "docs2", "f2", None)))
_TWO_SCORED = _TWO + """,
done AS (SELECT mailbox, uid, CASE WHEN margin > 0 THEN 'phishing' ELSE 'legitimate' END AS prediction,
                round(1.0 / (1.0 + exp(-margin)), 6) AS phishing_confidence FROM docs2 JOIN m2 ON m2.row_id = docs2.row_id)
"""


def _two_mailboxes(spark, sf_dir):
    """Two mailboxes that use the same uids."""
    inbox = S.mail_view(spark, sf_dir).select(F.lit("inbox").alias("mailbox"), "uid", "sender", "subject", "body")
    turns = S.table(spark, sf_dir, "conversations").select(
        F.lit("archive").alias("mailbox"), (F.col("conv_id") * 8 + F.col("turn") + 1).alias("uid"), F.col("role").alias("sender"),
        F.lit("turn").alias("subject"), F.col("text").alias("body"))
    return inbox.unionByName(turns)


@register("two_mailbox_scoring", _TWO_SCORED + "SELECT mailbox, uid, prediction, phishing_confidence FROM done")
def q_two_mailbox_scoring(spark, sf_dir):
    run = fixture_run(spark, sf_dir)
    c = CL.classify_messages(run.tfidf, run.nb, _two_mailboxes(spark, sf_dir), CL.trusted_domains(S.trusted_view(spark, sf_dir)))
    return c.select("mailbox", "uid", "prediction", r6("phishing_confidence").alias("phishing_confidence"))


def _streamed(spark, sf_dir) -> str:
    """The messages arrive in three deliveries, the last one all of them again, and
    two mailboxes use the same uids; some come five hours late. The scored folder."""
    from ..streaming.score import score_stream
    run = fixture_run(spark, sf_dir)
    root = scratch_path(spark, "stream")
    t0 = S.table(spark, sf_dir, "events").agg(F.min("ts").alias("t0")).first()["t0"]
    m = _two_mailboxes(spark, sf_dir)
    late = F.lit(t0) - F.expr("INTERVAL 5 HOURS")
    for part, arrival in ((m.filter("uid % 2 = 0"), F.lit(t0)), (m.filter("uid % 2 = 1"), late), (m, F.lit(t0))):
        part.withColumn("arrival", arrival.cast("timestamp")).write.mode("append").parquet(root + "/in")
    files = -(-len(spark.read.parquet(root + "/in").inputFiles()) // 3)  # about a delivery a batch
    dom = CL.trusted_domains(S.trusted_view(spark, sf_dir))
    score_stream(spark, root + "/in", root + "/out", root + "/ckpt", run.tfidf, run.nb, dom, max_files=files).awaitTermination()
    return root


@register("stream_scoring", _TWO_SCORED + "SELECT mailbox, uid, prediction, phishing_confidence FROM done")
def q_stream_scoring(spark, sf_dir):
    """Exactly one row per (mailbox, uid) comes out, late ones included."""
    out = spark.read.parquet(_streamed(spark, sf_dir) + "/out")
    return out.select("mailbox", "uid", "prediction", r6("phishing_confidence").alias("phishing_confidence"))


@register("stream_summary", _TWO_SCORED + "SELECT prediction, count(*) AS count FROM done GROUP BY prediction")
def q_stream_summary(spark, sf_dir):
    """Running counts per prediction over the stream's own output (T3)."""
    from ..streaming.score import latest_summary, stream_summary
    root = _streamed(spark, sf_dir)
    stream_summary(spark, root + "/out", root + "/summary", root + "/ckpt2").awaitTermination()
    return latest_summary(spark, root + "/summary")


@register("local_surrogate")
def q_local_surrogate(spark, sf_dir):
    """Local surrogate explanations of every stored message, whole texts, from
    the default number of copies."""
    run = fixture_run(spark, sf_dir)
    c = CL.classify_messages(run.tfidf, run.nb, S.mail_view(spark, sf_dir), CL.trusted_domains(S.trusted_view(spark, sf_dir)),
                             keep=("sender",), surrogate_samples=SG.SAMPLES)
    return c.select("uid", F.array_join(F.transform("surrogate_features", lambda x: x["feature"]), ", ").alias("features"),
                    "surrogate_summary")


@register("seeded_positions", Q.with_ctes() + """
SELECT uid, sender, row_number() OVER (ORDER BY md5(CAST(uid AS VARCHAR) || ':42'), uid) AS position FROM mail""")
def q_seeded_positions(spark, sf_dir):
    """The place of every row in the seeded order."""
    key = F.md5(F.concat(F.col("uid").cast("string"), F.lit(f":{K.SPLIT_SEED}")))
    return distributed_rank(S.mail_view(spark, sf_dir).select("uid", "sender"), [key, F.col("uid")], name="position")


@register("inbox_positions", Q.with_ctes() + "SELECT uid, subject, row_number() OVER (ORDER BY uid DESC) AS position FROM mail")
def q_inbox_positions(spark, sf_dir):
    """The place of every message, the newest first."""
    return distributed_rank(S.mail_view(spark, sf_dir).select("uid", "subject"), [F.desc("uid")], name="position")


_POLLS = """mails AS (SELECT 'inbox' AS mailbox, uid, sender FROM mail
         UNION ALL SELECT 'archive', conv_id * 8 + turn + 1, role FROM conversations),
thirds AS (SELECT mailbox, max(uid) AS top FROM mails GROUP BY mailbox)"""


@register("polled_messages", Q.with_ctes(_POLLS) + """
SELECT m.mailbox, m.uid, m.sender, CASE WHEN m.uid * 3 <= t.top THEN 1 WHEN m.uid * 3 <= 2 * t.top THEN 2 ELSE 3 END AS poll
FROM mails m JOIN thirds t ON t.mailbox = m.mailbox""")
def q_polled_messages(spark, sf_dir):
    """Three polls of two mailboxes that fill up by thirds; each poll sees all
    messages there so far, and gives those above its mailbox's position."""
    from ..sources.polling import Positions
    messages = _two_mailboxes(spark, sf_dir).select("mailbox", "uid", "sender")
    top = messages.groupBy("mailbox").agg(F.max("uid").alias("top"))  # a row a mailbox
    there = messages.join(F.broadcast(top), "mailbox")
    positions, out = Positions(spark, scratch_path(spark, "positions")), None
    for poll in (1, 2, 3):
        number, fresh = positions.poll(there.filter(F.col("uid") * 3 <= F.col("top") * poll).drop("top"))
        fresh = stored(fresh.withColumn("poll", F.lit(poll)), "polled")
        positions.advance(number, fresh)
        out = fresh if out is None else out.unionByName(fresh)
    return out


_COPIES = 3


@register("masked_copies", _MODEL.rstrip() + f""",
words AS (SELECT uid, regexp_extract_all(ctext, '{Q.WORD}+|[^\\p{{L}}\\p{{N}}_]+') AS parts FROM (
          SELECT uid, {Q.clean_text(Q.serving_text('subject', 'sender', 'body'))} AS ctext FROM mail)),
types AS (SELECT uid, parts, list_sort(list_distinct(list_filter(parts, lambda p: regexp_full_match(p, '{Q.WORD}+')))) AS t FROM words),
copies AS (SELECT uid * {_COPIES} + copy AS row_id, uid, copy, array_to_string(list_transform(parts, lambda p:
             CASE WHEN coalesce(list_position(t, p), 0) > 0 AND (list_position(t, p) - 1) % {_COPIES} = copy THEN '' ELSE p END), '') AS ctext
           FROM types, range({_COPIES}) r(copy)),
""" + ",\n".join(x.strip() for x in (Q.tf_cte("tf_copy", "copies", "ctext"), Q.tfidf_cte("ct", "tf_copy"), Q.engineered_pairs_cte("ce", "copies", "ctext"),
                                      "cf AS (SELECT * FROM ct UNION ALL SELECT * FROM ce)", Q.margins_cte("cm2", "copies", "cf", None))) + """
SELECT c.uid, CAST(c.copy AS INTEGER) AS copy, round(m.margin, 6) AS margin FROM copies c JOIN cm2 m ON m.row_id = c.row_id""")
def q_masked_copies(spark, sf_dir):
    """Margins of three copies of every message, each without a third of its word
    types, by the surrogate's matrix products."""
    run = fixture_run(spark, sf_dir)
    text = T.clean_text(M.serving_text("subject", "sender", "body")).alias("cleaned_text")
    found = SG.masked_margins(run.tfidf, run.nb, S.mail_view(spark, sf_dir).select("uid", text), "uid", _COPIES)
    return found.select("uid", "copy", r6("margin").alias("margin"))


# --- fixed values: some rules of the public suffix list ---
_SUFFIXES = ("com", "org", "net", "uk", "co.uk", "*.ck", "!www.ck")
_HOSTS = """hosts AS (SELECT page_id, CASE page_id % 6 WHEN 1 THEN host || '.co.uk' WHEN 2 THEN 'co.uk' WHEN 3 THEN 'www.ck'
            WHEN 4 THEN 'a' || page_id || '.b.ck' WHEN 5 THEN 'b.ck' ELSE host END AS domain
          FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host FROM pages))"""


@register("registered_domains", "WITH " + _HOSTS + f""",
parts AS (SELECT page_id, domain, list_filter(string_split(domain, '.'), lambda x: x <> '') AS l FROM hosts),
ends AS (SELECT page_id, domain, l, k, array_to_string(l[len(l) - k + 1:], '.') AS s, array_to_string(l[len(l) - k + 2:], '.') AS u
         FROM (SELECT *, unnest(range(1, len(l) + 1)) AS k FROM parts)),
found AS (SELECT page_id, max(k - 1) FILTER (s IN ({', '.join(Q.q(r[1:]) for r in _SUFFIXES if r[0] == '!')})) AS freed,
            max(k) FILTER (s IN ({', '.join(Q.q(r) for r in _SUFFIXES if r[0] not in '!*')})
                           OR (k > 1 AND u IN ({', '.join(Q.q(r[2:]) for r in _SUFFIXES if r[0] == '*')}))) AS fits FROM ends GROUP BY page_id)
SELECT p.page_id, p.domain, CASE WHEN len(l) > coalesce(freed, fits, 1) THEN array_to_string(l[len(l) - coalesce(freed, fits, 1):], '.') ELSE '' END
       AS registered FROM parts p LEFT JOIN found f ON f.page_id = p.page_id""")
def q_registered_domains(spark, sf_dir):
    """Registered domains of the pages' hosts (some moved under other suffixes)."""
    host = F.lower(F.regexp_extract("url", r"^https?://([^/?#]+)", 1))
    r = F.col("page_id") % 6
    domain = (F.when(r == 1, F.concat(host, F.lit(".co.uk"))).when(r == 2, "co.uk").when(r == 3, "www.ck")
              .when(r == 4, F.concat(F.lit("a"), F.col("page_id").cast("string"), F.lit(".b.ck"))).when(r == 5, "b.ck").otherwise(host))
    pages = S.table(spark, sf_dir, "pages").select("page_id", domain.alias("domain"))
    return pages.select("page_id", "domain", M.registered_domain("domain", _SUFFIXES).alias("registered"))
