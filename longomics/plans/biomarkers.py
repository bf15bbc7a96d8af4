"""Biomarker flows: fold-safe cross-validation, discovery, validation, signatures, survival, intents."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame, functions as F

from ..operators import classify, clinical, genetests, ordered, selection, signature, survival
from ..operators.moments import DS, GENE, SAMPLE, densify
from ..runtime import cut, small

# Study intents and what each needs.
INTENTS = {
    "diagnostic": {"study_design": "case_control", "validation_strategy": "nested_cv", "minimum_samples": 30,
                   "required_data_columns": ["expression", "group"],
                   "required_metrics": ["AUC", "sensitivity", "specificity", "PPV", "NPV"]},
    "prognostic": {"study_design": "cohort", "validation_strategy": "cox_cv", "minimum_samples": 50,
                   "required_data_columns": ["expression", "time", "event"],
                   "required_metrics": ["c_index", "HR", "HR_95CI", "logrank_p"]},
    "predictive": {"study_design": "interaction", "validation_strategy": "treatment_interaction_cv", "minimum_samples": 40,
                   "required_data_columns": ["expression", "treatment", "response"],
                   "required_metrics": ["interaction_p", "subgroup_AUC", "HR_by_arm"]},
    "monitoring": {"study_design": "longitudinal", "validation_strategy": "mixed_effects_cv", "minimum_samples": 20,
                   "required_data_columns": ["expression", "subject_id", "timepoint"],
                   "required_metrics": ["within_subject_change", "icc", "auc_trajectory"]},
    "exploratory": {"study_design": "unsupervised", "validation_strategy": "bootstrap_stability", "minimum_samples": 20,
                    "required_data_columns": ["expression"],
                    "required_metrics": ["cluster_stability", "explained_variance"]},
    "translational": {"study_design": "cross_species", "validation_strategy": "ortholog_concordance", "minimum_samples": 20,
                      "required_data_columns": ["expression", "group", "ortholog_map"],
                      "required_metrics": ["direction_concordance", "ortholog_coverage", "cross_species_AUC"]},
}


def check_intent(intent: str, columns: Sequence[str]) -> dict:
    """The intent's defaults; raises when a required column is missing."""
    if intent not in INTENTS:
        raise ValueError(f"intent must be one of {sorted(INTENTS)}")
    need = INTENTS[intent]["required_data_columns"]
    missing = [c for c in need if c not in columns]
    if missing:
        raise ValueError(f"intent {intent!r} requires {need}; missing {missing}")
    return INTENTS[intent]


def dense_cohort(values: DataFrame) -> DataFrame:
    """Dense (gene, sample, value, y) of one cohort from sparse prepared values."""
    labels = values.select(DS, SAMPLE, "y").distinct()
    return densify(values.select(DS, GENE, SAMPLE, "value"), "value").join(labels, [DS, SAMPLE])


def fold_cv(values: DataFrame, methods: Sequence[str], panel: int = 10, n_select: int = 50, folds: int = 5,
            repeats: int = 1, seed: int = 42, classifiers: Sequence[str] | None = None, trees: int = 100,
            de_genes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Selection, panel and fit inside every fold: held-out labels are never seen by either.

    Returns oof predictions, the folds' panels and per-fold metrics.
    """
    data = cut(values)
    samples = data.select(SAMPLE, "y").distinct()
    split = cut(classify.stratified_folds(samples, folds, repeats, seed))
    names = list(classifiers or classify.CLASSIFIERS)
    oof, panels = None, None
    for repeat in range(repeats):
        for fold in range(folds):
            mine = split.where((F.col("repeat") == repeat)).select(SAMPLE, "fold")
            tagged = data.join(small(mine), SAMPLE)
            train = cut(tagged.where(F.col("fold") != fold).drop("fold"))
            ranking = selection.rank_genes(train, methods, n_select, de_genes, seed + 1000 * repeat + fold)
            genes = selection.top_genes(ranking, panel)
            vectors = cut(selection.panel_vectors(data, genes).join(mine, SAMPLE))
            fits = classify.in_threads([
                (lambda n=n: classify.fit(vectors.where(F.col("fold") != fold), n, seed + fold, trees)) for n in names])
            for name, fitted in zip(names, fits):
                part = classify.predict(fitted, vectors.where(F.col("fold") == fold)).select(
                    F.lit(name).alias("classifier"), F.lit(repeat).alias("repeat"), F.lit(fold).alias("fold"), SAMPLE, "y", "prob")
                oof = part if oof is None else oof.unionByName(part)
            chosen = ranking.where(F.col("consensus_rank") <= panel).select(
                F.lit(repeat * folds + fold).alias("fold"), GENE, "consensus_rank")
            panels = chosen if panels is None else panels.unionByName(chosen)
    oof, panels = cut(oof), cut(panels)
    return {"oof": oof, "panels": panels, "fold_metrics": classify.threshold_metrics(oof, ["classifier", "repeat", "fold"])}


def discover(values: DataFrame, methods: Sequence[str] | None = None, min_panel: int = 3, max_panel: int = 10,
             target_size: int | None = None, strategy: str = "kneedle", n_select: int = 50, folds: int = 5,
             repeats: int = 1, seed: int = 42, classifiers: Sequence[str] | None = None, trees: int = 100,
             alpha: float = 0.05, de_genes: DataFrame | None = None, step: int = 1) -> dict[str, DataFrame]:
    """Scout size on all data, fold-safe CV at that size, final calibrated ranking and panel,
    stability and best classifier. ``values``: dense (dataset, gene, sample, value, y) of one cohort."""
    chosen = selection.resolve_methods(methods, de_genes is not None)
    data = cut(values)
    ranking = selection.rank_genes(data, chosen, n_select, de_genes, seed)
    curve = cut(selection.forward_curve(data, ranking, min_panel, max_panel, step, folds, seed, trees))
    size, how = (target_size, "user_specified") if target_size else selection.panel_size(selection.curve_points(curve), strategy)
    cv = fold_cv(data, chosen, size, n_select, folds, repeats, seed, classifiers, trees, de_genes)
    de = genetests.welch(data, selection.labels_of(data))
    final = cut(genetests.calibrate(ranking, de, alpha))
    panel = final.where(F.col("consensus_rank") <= size)
    n_genes = data.select(GENE).distinct().count()
    means = cut(classify.fold_means(cv["fold_metrics"]))
    return {"ranking": final, "panel": panel.withColumns({"panel_size": F.lit(size), "size_method": F.lit(how)}), "panel_curve": curve,
            "oof": cv["oof"], "fold_panels": cv["panels"], "fold_metrics": cv["fold_metrics"], "classifier_means": means,
            "best_classifier": classify.best_classifier(means),
            "stability": selection.panel_stability(cv["panels"], n_genes, folds * repeats, 1000, 0.95, seed)}


def validate(panel: DataFrame, values: DataFrame, folds: int = 5, seed: int = 42, classifiers: Sequence[str] | None = None,
             trees: int = 100) -> dict[str, DataFrame]:
    """Nested CV of a given panel on another cohort; at least one panel gene must be measured."""
    genes = [r[GENE] for r in panel.select(GENE).distinct().join(values.select(GENE).distinct(), GENE, "left_semi").orderBy(GENE).toLocalIterator()]
    if not genes:
        raise ValueError("no panel gene is present in the cohort")
    vectors = cut(selection.panel_vectors(values, genes))
    split = classify.stratified_folds(vectors, folds, 1, seed)
    oof = classify.cross_validate(vectors, split, classifiers, seed, trees)
    metrics = classify.threshold_metrics(oof, ["classifier", "repeat", "fold"])
    return {"oof": oof, "fold_metrics": metrics, "classifier_means": classify.fold_means(metrics),
            "roc": clinical.roc_points(oof, ["classifier"], "y", "prob")}


def diagnostic_signature(values: DataFrame, genes: Sequence, risk_groups: int = 2) -> dict:
    """Nearly unpenalised logistic weights on z-scored panel genes with learned cut-offs.

    Returns the signature table (gene, weight, mu, sd), intercept, cutoffs and training performance.
    """
    if risk_groups not in (2, 3):
        raise ValueError("risk_groups must be 2 or 3")
    kind = values.schema[GENE].dataType.simpleString()
    order = values.sparkSession.createDataFrame([(g, i) for i, g in enumerate(genes)], f"{GENE} {kind}, j int")
    norm = cut(signature.normalisation(values, order))
    sd = F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0)
    z = values.join(small(norm), GENE).select(SAMPLE, "y", GENE, ((F.col("value") - F.col("mu")) / sd).alias("value"))
    vectors = cut(classify.sample_matrix(z, order))
    model = LogisticRegression(featuresCol="features", labelCol="y", regParam=0.0, standardization=False, maxIter=500, tol=1e-9).fit(vectors)
    weights = values.sparkSession.createDataFrame(
        [(g, float(w)) for g, w in zip(genes, model.coefficients.toArray())], f"{GENE} {kind}, weight double")
    table = cut(norm.join(weights, GENE))
    scores = cut(signature.score_signature(table, values, float(model.intercept)).join(values.select(SAMPLE, "y").distinct(), SAMPLE))
    best = clinical.youden(scores, (), "y", "signature_score").first()
    if risk_groups == 2:
        cutoffs = {"threshold": float(best["threshold"])}
    else:
        q = ordered.quantiles(scores, [], "signature_score", {"lo": 1 / 3, "hi": 2 / 3}).first()
        cutoffs = {"low": float(q["lo"]), "high": float(q["hi"])}
    return {"signature": table, "intercept": float(model.intercept), "cutoffs": cutoffs, "scores": scores,
            "performance": {"auc": float(best["auc"]), "youden_j": float(best["youdens_j"])}}


def _survival_vectors(cells: DataFrame, genes: Sequence) -> DataFrame:
    """(sample_id, time, event, x) with genes z-scored in the given order."""
    kind = cells.schema[GENE].dataType.simpleString()
    order = cells.sparkSession.createDataFrame([(g, i) for i, g in enumerate(genes)], f"{GENE} {kind}, j int")
    stats = cells.groupBy(GENE).agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    z = cells.join(small(order), GENE).join(stats, GENE).withColumn(
        "z", (F.col("value") - F.col("mu")) / F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0))
    packed = z.groupBy(SAMPLE).agg(F.max("time").alias("time"), F.max("event").alias("event"), F.sort_array(F.collect_list(F.struct("j", "z"))).alias("c"))
    return packed.select(SAMPLE, "time", "event", F.col("c.z").alias("x"))


def _linear(vectors: DataFrame, beta: np.ndarray) -> DataFrame:
    eta = sum((F.col("x")[j] * float(b) for j, b in enumerate(beta)), F.lit(0.0))
    return vectors.select(SAMPLE, "time", "event", F.round(eta, 9).alias("score"))


def cox_lasso_panel(cells: DataFrame, alpha: float = 0.1, l1_ratio: float = 1.0) -> dict[str, DataFrame]:
    """Genes with a weight in the penalised model over all genes of ``cells``, and its concordance."""
    coefs, scores = survival.cox_lasso(cells, alpha, l1_ratio)
    return {"panel": coefs.where(F.abs("coef") > 1e-8), "c_index": survival.concordance_index(cut(scores))}


def survival_flow(cells: DataFrame, alpha: float = 0.1, fdr: float = 0.05) -> dict[str, DataFrame]:
    """Univariate screen, then a lasso panel over the significant genes (three or more needed)."""
    screen = cut(survival.cox_screen(cells.select(GENE, SAMPLE, "time", "event", "value"), fdr))
    chosen = screen.where("significant")
    out = {"screen": screen}
    if chosen.limit(3).count() == 3:
        out.update(cox_lasso_panel(cells.join(chosen.select(GENE), GENE, "left_semi"), alpha))
    else:
        out["panel"] = chosen.select(GENE, "coef")
    return out


def prognostic_signature(cells: DataFrame, genes: Sequence | None = None, risk_groups: int = 2, top: int = 5) -> dict:
    """Cox weights, C-index and the log-rank optimal cut-off (or tertiles for three groups)."""
    if genes is None:
        fit = survival.cox_univariate(cells.select(GENE, SAMPLE, "time", "event", "value"))
        genes = [r[GENE] for r in fit.orderBy("p_value", GENE).limit(top).collect()]
    vectors = cut(_survival_vectors(cells, genes))
    beta = survival.cox_fit(vectors, len(genes))
    scores = cut(_linear(vectors, beta))
    c = survival.concordance_index(scores).select("c_index")
    if risk_groups == 2:
        best = survival.best_cutoff(survival.logrank_scan(scores))
        median = ordered.quantiles(scores, [], "score", {"m": 0.5}).select("m")
        cut_row = best.crossJoin(F.broadcast(median)).select(F.coalesce("cutoff", "m").alias("cutoff"), "chi2")
    else:
        cut_row = ordered.quantiles(scores, [], "score", {"low": 1 / 3, "high": 2 / 3}).drop("n_values")
    return {"genes": genes, "beta": beta, "scores": scores, "cutoff": cut_row.crossJoin(F.broadcast(c))}


def enhance(values: DataFrame, discovery: dict[str, DataFrame], intent: str = "diagnostic", prevalence: float = 0.1,
            survival_cells: DataFrame | None = None, min_ratio_auc: float = 0.6, bootstrap: int = 500) -> dict:
    """Signature, direction pattern, clinical metrics on out-of-fold predictions and ratio pairs.

    A prognostic intent needs survival cells; nothing falls back to another intent silently.
    """
    if intent not in INTENTS:
        raise ValueError(f"intent must be one of {sorted(INTENTS)}")
    genes = selection.top_genes(discovery["panel"])
    out: dict = {"intent": INTENTS[intent]}
    if intent == "prognostic":
        if survival_cells is None:
            raise ValueError("the prognostic intent needs time and event")
        out["signature"] = prognostic_signature(survival_cells, genes)
        return out
    out["signature"] = diagnostic_signature(values, genes)
    panel_values = cut(values.where(F.col(GENE).isin(genes)))
    out["pattern"] = genetests.direction_pattern(genetests.welch(panel_values, selection.labels_of(panel_values)), 1.1, 0.0)
    best = discovery["best_classifier"].first()["classifier"]
    oof = cut(discovery["oof"].where(F.col("classifier") == best))
    youden = cut(clinical.youden(oof, (), "y", "prob"))
    v = clinical.ppv_npv(F.col("sensitivity"), F.col("specificity"), F.lit(prevalence))
    train = classify.predict(classify.fit(selection.panel_vectors(values, genes), best), selection.panel_vectors(values, genes))
    apparent = clinical.auc(train.select("y", "prob"), (), "y", "prob").select(F.col("auc").alias("train_auc"))
    out["clinical"] = youden.select("*", v["ppv"].alias("ppv"), v["npv"].alias("npv")).crossJoin(F.broadcast(apparent)).withColumn(
        "optimism_gap", F.col("train_auc") - F.col("auc"))
    out["bootstrap"] = clinical.bootstrap_auc(oof, (), bootstrap, 0.95, 42, "y", "prob")
    out["decision_curve"] = clinical.decision_curve(oof, (), None, "y", "prob")
    out["ratios"] = signature.search_ratios(panel_values, 50, min_ratio_auc)
    return out

