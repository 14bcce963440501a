"""Training-side studies and jobs built from the operators.

compare_models    M7: fit LR / NB / SVM over one feature table, score the
                  hold-out, evaluate all models in one grouped pass, pick the best
learning_curve    M8: folds x nested prefixes; all 25 cells fitted and judged
                  together; weighted F1
contribution      M9: growing source prefixes as a grouping key, each with its own
                  split and vocabulary over terms counted once; all models of all
                  stages fitted together
score_external    M10: clean, drop empty, score, append prediction + confidence
PRESETS           M11: parameter sets and source lists of the earlier versions
train_from_files  the whole run: five CSV shapes -> corpus -> models -> result tables
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import ENGLISH_STOP_WORDS, FOLDS, LEGITIMATE, MAX_FEATURES, NGRAM_MAX, PHISHING
from ..functions.text import clean_text, normalise_label, strip_ws
from ..operators import cells as CE
from ..operators import corpus as C
from ..operators import metrics as MT
from ..operators import models as MD
from ..operators import split as SP
from ..operators.explain import top_features
from ..operators.tfidf import TfidfModel
from ..session import materialise as stored
from ..session import scratch_path
from ..sources.io import read_corpus, save_model, write_table
from .pipeline import TextRun, materialise

MODEL_ORDER = ("Logistic Regression", "Naive Bayes", "SVM")


def compare_models(run: TextRun, models=MODEL_ORDER) -> tuple[DataFrame, DataFrame, str | None]:
    """(results, scored_all, best_name). results: model, model_rank, accuracy,
    precision, recall, f1_score - one grouped pass over all predictions."""
    run.fit(models)
    scored = None
    for rank, name in enumerate(models):
        s = run.scored(run.model(name)).withColumn("model", F.lit(name)).withColumn("model_rank", F.lit(rank))
        scored = s if scored is None else scored.unionByName(s)
    results = MT.binary_metrics(scored, by=("model", "model_rank"))
    best = MT.best_model(results).collect()
    return results, scored, (best[0]["model"] if best else None)


# ------------------------------------------------------------ learning curve

def learning_curve(run: TextRun, name: str, k: int = FOLDS) -> DataFrame:
    """(size, train_score, validation_score) of the named model: the mean
    weighted F1 over the folds.

    Every (fold, size) is a cell. A row lists the cells whose prefix it is in and
    those it validates, so the features are stored once, all models are fitted
    together and one pass counts the predictions of all of them."""
    folded = SP.stratified_folds(run.train.select("row_id", "label"), k).select("row_id", "fold")
    prefixes = materialise(SP.train_prefixes(SP.stratified_folds(run.train.select("row_id", "label"), k), k))
    grid = sorted((r[0], r[1]) for r in prefixes.select("fold", "size").distinct().collect())  # k folds x 5 sizes
    number = {cell: i for i, cell in enumerate(grid)}
    spark = run.spark
    numbers = F.broadcast(spark.createDataFrame([(f, s, i) for (f, s), i in number.items()], "fold int, size int, cell int"))
    cells = prefixes.join(numbers, ["fold", "size"]).groupBy("row_id").agg(F.collect_list("cell").alias("cells"))  # k x 5 at most
    of_fold = F.broadcast(numbers.groupBy("fold").agg(F.collect_list("cell").alias("held")))
    feats = (run.train_features.select("row_id", "label", "pairs").join(folded, "row_id").join(of_fold, "fold", "left")
             .join(cells, "row_id", "left"))
    table = CE.cell_table(feats, run.n_features, cells="cells", held="held")
    fitted = CE.fit_columns(table, [MD.model_column(name, i, run.balanced, key=cell) for cell, i in number.items()])
    counts = CE.cell_confusions(table, fitted).join(
        F.broadcast(spark.createDataFrame([(i, *cell) for cell, i in number.items()], "column int, fold int, size int")), "column")
    report = MT.classification_report(counts, by=("fold", "size", "kind"))
    f1 = report.filter(F.col("class") == "weighted avg").select("fold", "size", "kind", F.col("f1").alias("weighted_f1"))
    return (f1.groupBy("size").pivot("kind", ["train", "validation"]).agg(F.avg("weighted_f1"))
            .select("size", F.col("train").alias("train_score"), F.col("validation").alias("validation_score")))


# ------------------------------------------------------------ many training sets, many models

@dataclass
class Study:
    """A training set of a comparison: its features (label, part, pairs), their
    number, and whether logistic regression balances its classes."""
    name: str
    features: DataFrame
    n_features: int
    balanced: bool = True


def compare_studies(studies: list[Study], models=MODEL_ORDER) -> list[tuple]:
    """(study, model, accuracy, precision, recall, f1) of the hold-outs, in order.
    All models of all studies are fitted together over one table: a study is a
    cell, its rows carry its number."""
    if not studies:
        return []
    rows, none = None, F.array().cast("array<int>")
    for i, st in enumerate(studies):
        own, train = F.array(F.lit(i)), F.col("part") == "train"
        part = st.features.select("label", "pairs", F.when(train, own).otherwise(none).alias("cells"), F.when(train, none).otherwise(own).alias("held"))
        rows = part if rows is None else rows.unionByName(part)
    table = CE.cell_table(rows, max(st.n_features for st in studies), cells="cells", held="held")
    columns = [MD.model_column(m, i, st.balanced, st.n_features, key=(i, m)) for i, st in enumerate(studies) for m in models]
    fitted = CE.fit_columns(table, columns)
    held = CE.cell_confusions(table, fitted).filter("kind = 'validation'")
    found = {r["column"]: r for r in MT.binary_metrics(held, by=("column",)).collect()}  # a row a model
    return [(studies[c.name[0]].name, c.name[1], *[found[k][m] for m in ("accuracy", "precision", "recall", "f1_score")])
            for k, c in enumerate(columns) if k in found]


def contribution(corpus_by_source: DataFrame, stage_names: list[str], models=MODEL_ORDER,
                 max_features: int = MAX_FEATURES, dedupe: bool = False) -> DataFrame:
    """Rows: dataset, model, accuracy, precision, recall, f1. Stage s holds the
    first s sources, re-cleaned; single-class stages are skipped. ``dedupe`` keeps
    the first of equal (text, label) rows, as the main run does.

    The stage is a grouping key: texts are tokenised and counted once, a row
    belongs to the stages from its source on, and one plan each makes all splits,
    all vocabularies and all models."""
    base = C.finalise(corpus_by_source)
    if dedupe:  # the first of equal rows has the least source, so it is the first in every stage that has one
        base = C.dedupe_first(base)
    terms = MD.counted_terms((ENGLISH_STOP_WORDS, NGRAM_MAX), base, keep=("row_id", "source_rank", "label"))
    counted = stored(terms, "counted-terms")
    stages = F.sequence(F.col("source_rank").cast("int") + 1, F.lit(len(stage_names)))
    classes = counted.select("label", F.explode(stages).alias("stage")).groupBy("stage").agg(F.countDistinct("label").alias("n")).filter("n > 1")
    usable = sorted(r["stage"] for r in classes.collect())  # a row a stage
    schema = "dataset string, model string, accuracy double, precision double, recall double, f1 double"
    spark = corpus_by_source.sparkSession
    if not usable:
        return spark.createDataFrame([], schema)
    own = F.array_intersect(stages, F.array(*[F.lit(s) for s in usable]))
    parts = SP.grouped_split(counted.select("row_id", "label", "_feats", "tc", own.alias("stages")), "stages")
    vocabularies = TfidfModel.fit_groups(parts.filter(F.size("train") > 0), "train", max_features)
    studies = []
    for s in usable:
        model = vocabularies[s]
        part = F.when(F.array_contains("train", s), F.lit("train")).otherwise(F.lit("test")).alias("part")
        rows = parts.filter(F.array_contains("stages", s)).select("label", part, "_feats", "tc")
        feats = MD.featurise_terms(model, rows, keep=("label", "part"))
        studies.append(Study(stage_names[s - 1], feats, len(MD.feature_names(model))))
    return spark.createDataFrame(compare_studies(studies, models), schema)


# ------------------------------------------------------------ external scoring

def score_external(tfidf: TfidfModel, model: MD.LinearModel, df: DataFrame, text: str = "text") -> DataFrame:
    """Clean (one pass), drop empty text, score; every other column is kept.
    phishing_confidence is null for models without probabilities. Map-only."""
    cols = [c for c in df.columns if c != text]
    d = df.filter(C.has_text([text])).select(*cols, clean_text(text).alias(text))
    s = MD.featurise(tfidf, d, text=text, keep=[*cols, text]).select(*cols, text, model.margin().alias("_m"))
    conf = F.lit(None).cast("double") if not model.has_proba else 1.0 / (1.0 + F.exp(-F.col("_m")))
    return s.select(*cols, text, F.when(F.col("_m") > 0, F.lit(PHISHING)).otherwise(F.lit(LEGITIMATE)).alias("predicted_label"),
                    conf.alias("phishing_confidence"))


# ------------------------------------------------------------ presets

@dataclass(frozen=True)
class PipelineConfig:
    name: str
    sources: int           # the first so many of the five sources
    max_features: int
    min_df: int
    sublinear: bool
    balanced: bool
    engineered: bool
    clean_case: bool       # lower-case + label removal in cleaning (else strip only)

    @staticmethod
    def preset(name: str) -> "PipelineConfig":
        return PRESETS[name]


# --- fixed values: parameters of the current and the two earlier versions ---
PRESETS = {
    "current": PipelineConfig("current", 5, 15000, 2, True, True, True, True),
    "before_phishtank": PipelineConfig("before_phishtank", 4, 10000, 1, False, False, False, False),
    "before_kaggle": PipelineConfig("before_kaggle", 3, 10000, 1, False, False, False, False),
}


def preset_runs(raw: DataFrame, models=MODEL_ORDER) -> DataFrame:
    """Rows: preset, model, accuracy, precision, recall, f1_score. Each preset
    trains on its own sources of ``raw`` (the corpus view), cleaned its way; the
    models of all presets are fitted together."""
    spark, studies, runs = raw.sparkSession, [], []
    for name, cfg in PRESETS.items():
        own = raw.filter(F.col("source_rank") < cfg.sources)
        if cfg.clean_case:
            corpus = C.build_corpus(own)
        else:
            strip = strip_ws(F.coalesce("raw_text", F.lit("")))
            corpus = C.dedupe_first(C.valid_raw(own, "raw_text", "raw_label").select(
                "row_id", "source_rank", "row_no", "source", strip.alias("text"), normalise_label("raw_label").alias("label")))
        run = TextRun(spark, materialise(corpus), max_features=cfg.max_features, min_df=cfg.min_df,
                      sublinear=cfg.sublinear, engineered=cfg.engineered, balanced=cfg.balanced)
        runs.append(run)
        studies.append(Study(name, run.features, run.n_features, cfg.balanced))
    rows = compare_studies(studies, models)
    for run in runs:
        run.release()
    return spark.createDataFrame(rows, "preset string, model string, accuracy double, precision double, recall double, f1_score double")


# ------------------------------------------------------------ the run from files

# --- fixed values: the five file shapes, in the order of their union ---
FILE_SOURCES = (
    C.SourceSpec("labelled", 0, ("text",), label_col="label"),
    C.SourceSpec("legitimate mail", 1, ("subject", "body"), constant_label=LEGITIMATE),
    C.SourceSpec("phishing mail", 2, ("subject", "body"), constant_label=PHISHING),
    C.SourceSpec("typed mail", 3, ("Email Text",), label_col="Email Type", keep_label=PHISHING, pre_clean=1),
    C.SourceSpec("full mail", 4, ("sender", "subject", "body"), label_col="label"),
)


def sources_from_files(spark: SparkSession, paths: list[str], specs=FILE_SOURCES) -> DataFrame:
    """CSV files -> the union of their canonical rows, as a stored table. Each file
    is read once, its columns picked by name, numbered and written before anything else."""
    parts = []
    for path, spec in zip(paths, specs, strict=True):
        wanted = [*spec.text_cols, *([spec.label_col] if spec.label_col else [])]
        parts.append(C.canonicalise(stored(read_corpus(spark, path, wanted, row_id="row_id"), "source"), spec))
    return stored(C.combine(parts), "sources")


def corpus_from_files(spark: SparkSession, paths: list[str], specs=FILE_SOURCES) -> DataFrame:
    """CSV files -> the cleaned, deduplicated corpus."""
    return C.dedupe_first(C.finalise(sources_from_files(spark, paths, specs)))


def train_from_files(spark: SparkSession, paths: list[str], out_dir: str, models=MODEL_ORDER, specs=FILE_SOURCES,
                     fmt: str = "csv", studies: bool = True, external: dict[str, DataFrame] | None = None) -> tuple[TextRun, str | None]:
    """The whole training run; its tables go to ``out_dir``: corpus, class
    distribution, source breakdown, model results, a report of every model, its
    errors, false positives and false negatives (with their texts), and of the
    best model the top terms and the model itself.

    ``studies`` adds the contribution of the sources and the best model's learning
    curve; ``external`` names tables with a text column, whose predictions by the
    best model are written as external_<name>."""
    sources = sources_from_files(spark, paths, specs)
    run = TextRun(spark, materialise(C.require_unique(C.dedupe_first(C.finalise(sources)))))
    write_table(run.corpus, out_dir, "corpus", "parquet")
    write_table(C.class_distribution(run.corpus), out_dir, "class_distribution", fmt)
    write_table(C.source_breakdown(run.corpus), out_dir, "source_breakdown", fmt)
    results, scored, best = compare_models(run, models)
    write_table(results, out_dir, "model_results", fmt)
    write_table(MT.classification_report(scored, by=("model",)), out_dir, "classification_reports", fmt)
    errors = stored(run.with_text(MT.error_tables(scored, keep=("row_id", "model"))), "errors")
    for kind, name in (("misclassified", "errors"), ("false_positive", "false_positives"), ("false_negative", "false_negatives")):
        write_table(errors.filter(F.col("kind") == kind), out_dir, name, fmt)
    if studies:
        names = [spec.name for spec in specs]
        write_table(contribution(sources, [" + ".join(names[: i + 1]) for i in range(len(names))], models), out_dir, "contribution", fmt)
    if best is not None:
        model = run.model(best)
        write_table(top_features(model.coefficients(spark)), out_dir, "top_features", fmt)
        save_model(spark, f"{out_dir}/model", run.tfidf, model)
        if studies:
            write_table(learning_curve(run, best), out_dir, "learning_curve", fmt)
        for name, table in (external or {}).items():
            write_table(score_external(run.tfidf, model, table), out_dir, f"external_{name}", fmt)
    return run, best
