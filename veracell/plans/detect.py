"""The flagship plan: a dirty table in, scored and explained cells out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracell.functions import numeric
from veracell.operators import cells as ce
from veracell.operators import evaluate as ev
from veracell.operators import evidence as evi
from veracell.operators import inference as inf
from veracell.operators import relations as rel
from veracell.operators import repair as rp
from veracell.operators import rules as ru
from veracell.operators import scores as sc
from veracell.operators.quantiles import exact


@dataclass
class DetectConfig:
    """Settings of a run. ``unit_weights`` scores without labels: each feature
    counts 1, which the calibrated mode never assumes.

    ``legal`` has the value signatures of closed columns, ``relations`` for a column
    (other column, kind, violation rate), ``dependencies`` accepted (determinant,
    dependent) pairs, ``rules`` clean rules, of which those of the pattern family
    speak for or against a cell by their pass ratio, and ``repairs`` operations
    whose candidates count as evidence.
    """

    columns: list[str]
    kinds: dict[str, str]
    archetypes: dict[str, str] = field(default_factory=dict)
    patterns: dict[str, str] = field(default_factory=dict)
    context: list[str] = field(default_factory=list)
    clean: dict[str, str] = field(default_factory=dict)
    legal: dict[str, tuple[str, ...]] = field(default_factory=dict)
    prototypes: int = 0
    relations: dict[str, list[tuple[str, str, float]]] = field(default_factory=dict)
    dependencies: frozenset = frozenset()
    rules: list = field(default_factory=list)
    repairs: list = field(default_factory=list)
    prior: float = 0.05
    threshold: float = 0.5
    label_budget: int = 10
    gating_mode: str = "hard"
    label_supported: bool = False
    rule_scale: float = 1.0
    unit_weights: bool = False
    weights: dict[str, float] | None = None
    intercept: float | None = None


@dataclass
class Detection:
    """``cells`` has a row for every cell; the persisted frames behind it are
    freed by ``close``."""

    cells: DataFrame
    evidence: DataFrame
    thresholds: dict[str, float]
    weights: dict[str, float] | None
    intercept: float
    labels: dict[tuple[int, str], int]
    support: dict[tuple[str, str], tuple[int, int]]
    promoted: list[str]
    repairs: DataFrame | None = None
    held: tuple[DataFrame, ...] = ()

    def close(self) -> None:
        for frame in self.held:
            frame.unpersist()

    @property
    def observations(self) -> DataFrame:
        """The evidence as drawn, a row each."""
        return evi.flat(self.evidence.select("row_idx", "column", "obs"))

    @property
    def posteriors(self) -> DataFrame:
        return self.cells.select("row_idx", "column", "logit", "posterior")

    @property
    def explanations(self) -> DataFrame:
        names = ("row_idx", "column", "posterior", "threshold", "decision", "hard_label", "primary_reason", "supporting", "counter", "explanation")
        return self.cells.select(*names)


def specs_of(df: DataFrame, cell: DataFrame, value: DataFrame, config: DetectConfig) -> list[evi.ColumnSpec]:
    numbers = [c for c, k in config.kinds.items() if k == "numeric"]
    number = cell.where(F.col("column").isin(*numbers)).select("column", numeric.strict(F.col("raw")).alias("x"), *(["n"] if "n" in cell.columns else []))
    names = ("p01", "p05", "p95", "p99")
    quantiles = {c: dict(zip(names, q)) for c, q in exact(number, [0.01, 0.05, 0.95, 0.99]).items()} if numbers else {}
    return evi.infer_specs(value, cell, config.kinds, config.patterns, quantiles, config.archetypes, config.legal, config.prototypes)


def drawn(df: DataFrame, config: DetectConfig, cell: DataFrame, value: DataFrame, specs: list[evi.ColumnSpec], repairs: DataFrame | None = None) -> DataFrame:
    """row_idx, column, raw, sig and ``obs``, all observations of every cell.

    Values meet their cells once; what contexts, dependencies and repairs say is
    gathered by cell once; relations and rules are columns of the cell's own row.
    """
    extra = []
    if len(config.context) > 1:
        identifiers = frozenset(c for c, a in config.archetypes.items() if a == "identifier")
        said = rel.consensus(df, config.context, df.count(), identifiers, frozenset(config.dependencies))
        extra.append(evi.consensus_evidence(said).where(F.col("column").isin(*config.columns)))
    if repairs is not None:
        extra.append(rp.repair_evidence(repairs))
    firsts = value.select("column", "sig", "support", "first_raw", "first_row")
    by_rule = {c: [r for r in config.rules if r.column == c and r.family == "pattern"] for c in config.columns}
    by_rule = {c: rs for c, rs in by_rule.items() if rs}
    if by_rule:
        ratios = ru.pass_ratios(df, by_rule)
        firsts = firsts.join(ratios.withColumnsRenamed({"row_idx": "first_row"}), ["column", "first_row"], "left")
        cell = cell.join(ratios, ["row_idx", "column"], "left")
    of_value = evi.value_arrays(firsts, specs).withColumnRenamed("obs", "of_value").withColumn("_n", F.col("support"))
    c = ce.spread(cell, of_value, ["column", "sig"], value.limit(ce.FEW + 1).count() <= ce.FEW, "_n")
    if config.relations:
        c = c.join(evi.relation_arrays(df, config.relations).withColumnRenamed("obs", "related"), ["row_idx", "column"], "left")
    keep = ("raw", "sig", "of_value", *(["related"] if config.relations else []))
    out = evi.cell_arrays(c, specs, keep)
    parts = [F.col("of_value"), F.col("obs"), *([F.coalesce("related", F.slice("obs", 1, 0))] if config.relations else [])]
    if extra:
        out = out.join(evi.gathered(extra), ["row_idx", "column"], "left")
        parts.append(F.coalesce("more", F.slice("obs", 1, 0)))
    return sc.one_of_each(out.select("row_idx", "column", "raw", "sig", F.concat(*parts).alias("obs")))


def detect(df: DataFrame, config: DetectConfig) -> Detection:
    """Evidence, calibration on few labels, gating, scores, explanations.

    Weights are learned on evidence as drawn; labels then promote structural
    missing values and allow gates, and the gates weaken what is left. With
    ``weights`` and ``intercept`` the given calibration is used as it is. Where all
    evidence is of a cell's own value, everything is worked out for the first cell of
    each distinct value and then given to all.
    """
    spark = df.sparkSession
    by_row = len(config.context) > 1 or config.repairs or config.relations or any(r.family == "pattern" for r in config.rules)
    forms = None if by_row else ce.Forms(df, config.columns)
    cell = forms.rows if forms else ce.cells(df, config.columns)
    value = ce.values(cell)
    repairs = rp.candidates(df, config.repairs) if config.repairs else None
    evidence = drawn(df, config, cell, value, specs_of(df, cell, value, config), repairs)
    evidence = sc.rules_scaled(evidence, config.rule_scale).persist(StorageLevel.MEMORY_AND_DISK)
    kinds, labels, labelled = config.archetypes, {}, []
    if config.clean and config.label_budget and not config.unit_weights and config.weights is None:
        vectors = sc.vectors(evidence)
        asked = inf.choose_queries(forms.weighted(vectors) if forms else vectors, config.label_budget)
        missing = F.exists("obs", lambda o: (o["source"] == "missing_token") & ~o["hard"])
        kind = F.coalesce(F.try_element_at(F.create_map(*[x for c in config.columns for x in (F.lit(c), F.lit(kinds.get(c, "unknown")))]), F.col("column")), F.lit("unknown"))
        first = evidence.where(missing).groupBy(kind.alias("kind")).agg(F.min(F.struct("row_idx", "column")).alias("cell")).collect()  # a row an archetype
        keys = lambda cells: F.broadcast(spark.createDataFrame(cells, "row_idx bigint, column string"))
        soft = set()
        if first and asked:
            soft = {(r.row_idx, r.column) for r in evidence.where(missing).join(keys(asked), ["row_idx", "column"]).select("row_idx", "column").collect()}
            asked = inf.cover_structural(asked, config.label_budget, {r.kind: tuple(r.cell) for r in first}, soft, kinds)
        if asked:
            true = ev.truth(df, config.clean).select("row_idx", "column", "label").join(keys(asked), ["row_idx", "column"])
            labelled = true.join(evidence, ["row_idx", "column"]).collect()  # the label budget's cells
            labels = {(r.row_idx, r.column): r.label for r in labelled}
    if config.weights is not None:
        intercept, weights = config.intercept, config.weights
    else:
        intercept, weights = inf.fitted(labelled, config.prior)
        weights = None if config.unit_weights else weights
    supported, support = inf.supported_policies(labelled, kinds)
    up = inf.promoted_columns(labelled, kinds)
    scales = sc.gate_scales(kinds, config.gating_mode, support=support, confidence={c: 0.65 for c in kinds}, supported=supported if config.label_supported else None)
    scored = sc.scored(sc.gated(sc.promoted(evidence, up), scales), intercept, weights)
    limits: dict[str, float] = {}
    if labels:
        known = spark.createDataFrame([(r, c, y) for (r, c), y in labels.items()], "row_idx bigint, column string, label int")
        rows = scored.join(F.broadcast(known), ["row_idx", "column"]).select("column", "posterior", "label")
        limits = {r.column: r.threshold for r in inf.thresholds(rows, config.threshold).collect()}
    to_all = (lambda found: forms.to_cells(found.drop("raw"), forms.cell, keep=True).select(*found.columns)) if forms else (lambda found: found)
    held = (evidence, forms.rows) if forms else (evidence,)
    return Detection(to_all(sc.explained(scored, config.threshold, limits)), to_all(evidence), limits, weights, intercept, labels, support, up, repairs, held)


def export(found: Detection) -> DataFrame:
    """The row of a score file for every cell: value prior, score, labels, evidence
    in words, the best repair, reasons and the whole trace."""
    c = found.cells
    prior = c.groupBy("column", "sig").agg(F.avg("posterior").alias("value_prior"), F.count("*").alias("n"))
    out = ce.spread(c, prior, ["column", "sig"], prior.limit(ce.FEW + 1).count() <= ce.FEW)
    if found.repairs is not None:
        best = found.repairs.where("rank = 1").select("row_idx", "column", F.col("mechanism").alias("repair_mechanism"), F.col("candidate").alias("repair_candidate"),
                                                      F.col("score").alias("repair_score"), F.col("ambiguity").alias("repair_ambiguity"), F.col("changed").alias("repair_changed_fields"))
        out = out.join(best, ["row_idx", "column"], "left")
    else:
        none = {"repair_mechanism": "string", "repair_candidate": "string", "repair_score": "double", "repair_ambiguity": "double", "repair_changed_fields": "string"}
        out = out.select("*", *[F.lit(None).cast(t).alias(n) for n, t in none.items()])
    used = F.exists("evidence", lambda e: (e["family"] == "canonicalization") & (e["contribution"] > sc.NOTHING))
    asked = F.lit(False)
    truth = F.lit("")
    for (row, column), label in found.labels.items():
        own = (F.col("row_idx") == row) & (F.col("column") == column)
        asked, truth = asked | own, F.when(own, F.lit("dirty" if label else "clean")).otherwise(truth)
    scope = lambda name: sc.summary(F.filter("evidence", lambda e: e["scope"] == name))
    trace = F.to_json(F.struct("row_idx", "column", "posterior", "logit", "threshold", "decision", "hard_label", "evidence"))
    return out.select(
        F.concat_ws("::", F.col("row_idx").cast("string"), "column").alias("cell_key"), F.col("row_idx").alias("row_index"), "column", F.col("raw").alias("value"),
        F.concat_ws("::", "column", "sig").alias("value_key"), "value_prior", numeric.certainty(F.col("value_prior")).alias("value_prior_confidence"),
        F.col("posterior").alias("cell_posterior"), F.col("certainty").alias("cell_confidence"), F.col("certainty").alias("decision_certainty"), "threshold", "decision",
        "hard_label", F.col("hard_reasons").alias("hard_reason_summary"), asked.alias("queried_for_calibration"), truth.alias("active_oracle_label"),
        scope("value").alias("value_evidence_summary"), scope("cell").alias("cell_evidence_summary"),
        "repair_mechanism", "repair_candidate", F.col("repair_score").alias("repair_detection_confidence"), (F.col("repair_score") * (1 - F.col("repair_ambiguity"))).alias("repairability_score"),
        "repair_ambiguity", used.alias("repair_used_in_inference"), (used & (F.col("decision") == "dirty") & F.col("repair_candidate").isNotNull()).alias("repair_recommended"),
        "repair_changed_fields", "primary_reason", F.col("supporting").alias("supporting_reasons"), F.col("counter").alias("counter_evidence"),
        F.col("explanation").alias("natural_language_explanation"), trace.alias("explanation_trace"))
