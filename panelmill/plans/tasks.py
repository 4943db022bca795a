"""A labelling job from its description to the written result, production and audit rows."""

import time
from collections.abc import Sequence
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill import schemas
from panelmill.constants import SLICE_HOURS
from panelmill.functions.slices import with_slices, with_slices_compat
from panelmill.functions.text import target_name
from panelmill.operators import audit
from panelmill.operators import label as lab
from panelmill.operators import metrics
from panelmill.operators.clean import AUTHOR, slice_votes, task_votes, trimmed
from panelmill.sources import rules as rule_sources
from panelmill.sources import tables
from panelmill.sources.posts import read_posts
from panelmill.spec import JobSpec


def received_posts(posts: DataFrame, spec: JobSpec) -> DataFrame:
    """All posts of a job, of whatever site, with their slice."""
    present = posts.where(F.col("author").isNotNull() & F.col("s_id").isNotNull()
                          & F.col(target_name(spec.target)).isNotNull())
    slicer = with_slices_compat if spec.compat_slices else with_slices
    return slicer(present, spec.start, spec.end)


def labelled_posts(posts: DataFrame, spec: JobSpec, source_map: DataFrame,
                   matched_only: bool = False, rules=None) -> DataFrame:
    """Result rows of all posts of a job, with source and slice; panel '' where nothing matched, or such
    rows left out.  ``rules`` is what the job's labels come from, if that is not in the description itself."""
    routed = lab.route_to_sources(received_posts(posts, spec), source_map)
    labelled = lab.label_posts(routed, spec.model_type, spec.rules if rules is None else rules, spec.target,
                               spec.case_sensitive, spec.na_label, matched_only)
    return lab.project_results(labelled, spec.target, spec.task_id)


def load_rules(spark: SparkSession, spec: JobSpec):
    """What a job labels with: its rules, or the stored term dictionary or forest it names."""
    if not spec.model_path:
        return spec.rules
    if spec.model_type == "term_weight_model":
        out: dict = {}
        # A dictionary has at most constants.TERM_MAX_FEATURES terms per label.
        for r in rule_sources.read_term_dict(spark, spec.model_path).orderBy("label", F.desc("weight"), "term").collect():
            out.setdefault(r["label"], []).append((r["term"], r["weight"]))
        return out
    if spec.model_type == "random_forest_model":
        from panelmill.operators.forest import load_model
        return load_model(spec.model_path)
    raise ValueError(f"{spec.model_type} takes rules, not a stored model")


def panels_of(spec: JobSpec, rules=None) -> list[str]:
    """Panel names the job can produce, in result form."""
    from panelmill.constants import LABEL_NAMES
    rules = spec.rules if rules is None else rules
    if isinstance(rules, dict):
        names = list(rules) + ([spec.na_label] if spec.na_label else [])
    else:
        from panelmill.operators.forest import class_names
        names = class_names(rules)
    return list(dict.fromkeys("/" + LABEL_NAMES.get(name, name) for name in names))


def named(matched: DataFrame) -> DataFrame:
    """Labelled rows with their final panel names."""
    return matched.withColumn("panel", lab.panel_name(F.col("panel")))


def slice_results(matched: DataFrame, spec: JobSpec, rules=None, parts: Sequence[str] = ()) -> DataFrame:
    """Rows of the result table out of the matched posts: one per slice, author and winning panel."""
    out = slice_votes(named(matched), keys=["source"], tie=spec.tie, parts=parts)
    return out.select(*schemas.RESULT_COLUMNS, "source")


def production_rows(results: DataFrame, spec: JobSpec, rules=None, parts: Sequence[str] = ()) -> DataFrame:
    return task_votes(results, ["source"], spec.tie, parts)


def final_panel(column: str = "panel"):
    """Final panel name; '' stays ''."""
    return F.when(F.col(column) == "", "").otherwise(lab.panel_name(F.col(column)))


def job_panels(rows: DataFrame, spec: JobSpec, rules=None) -> DataFrame:
    """Panel and counters per author straight from the labelled posts, without the written tables."""
    slim = trimmed(rows.select("source", "slice", AUTHOR, final_panel().alias("panel")))
    return metrics.author_panels(slim, panels_of(spec, rules), tie=spec.tie)


def job_metrics(rows: DataFrame, spec: JobSpec, rules=None) -> DataFrame:
    """Figures per source of a job."""
    return metrics.source_metrics(job_panels(rows, spec, rules)).withColumn("task_id", F.lit(spec.task_id))


def audit_row(spark: SparkSession, spec: JobSpec, seq: int, stat: str, **values) -> DataFrame:
    base = {c: None for c in schemas.AUDIT.names}
    base.update(task_id=spec.task_id, seq=seq, stat=stat, model_type=spec.model_type, predict_type=spec.target,
                date_range=spec.date_range, target_table=spec.input_name, create_time=datetime.now())
    base.update(values)
    return spark.createDataFrame([tuple(base[c] for c in schemas.AUDIT.names)], schemas.AUDIT)


def audit_frame(states: DataFrame) -> DataFrame:
    """Task states that are a table, such as another log, as rows of the audit log; what they do not have is null."""
    have = set(states.columns)
    return states.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.AUDIT])


def append_audit(rows: DataFrame, output: str) -> None:
    rows.write.mode("append").parquet(f"{output}/audit")


def batches(spec: JobSpec) -> list[JobSpec]:
    """The job cut into ranges of whole slices; one if it names no batch size."""
    if not spec.batch_slices:
        return [spec]
    if spec.compat_slices:
        raise ValueError("slices closed at both ends share posts and cannot be cut into batches")
    step = timedelta(hours=SLICE_HOURS * spec.batch_slices)
    cuts = [spec.start]
    while cuts[-1] + step < spec.end:
        cuts.append(cuts[-1] + step)
    return [replace(spec, start=a, end=b) for a, b in zip(cuts, [*cuts[1:], spec.end])]


def resume_from(spark: SparkSession, spec: JobSpec) -> datetime | None:
    """Check point of the task's last state, if that is a failure."""
    last = audit.task_by_id(read_audit(spark, spec.output), spec.task_id).select("stat", "check_point").collect()
    return last[0]["check_point"] if last and last[0]["stat"] == "FAILURE" else None


def run_task(spark: SparkSession, spec: JobSpec, source_map: DataFrame | None = None,
             posts: DataFrame | None = None, resume: bool = False) -> DataFrame:
    """Run a job: write results and production, append the audit rows, return the figures per source.

    A run replaces all results and production rows that the task had.  Batches of slices are written one after the
    other; a failure is recorded with its message and the start of the batch it happened in, and raised again.  With
    ``resume`` a failed task goes on from there.  Production reads the written results back, so an executor lost late
    in the job costs no labelling work; the audit row of success comes last, and dumps take finished tasks only.
    """
    began = time.time()
    seq = time.time_ns()
    if source_map is None:
        if not spec.source_map:
            raise ValueError("a job needs the map of its site ids to sources")
        source_map = rule_sources.read_source_map(spark, spec.source_map)
    at = (resume_from(spark, spec) if resume else None) or spec.start
    append_audit(audit_row(spark, spec, seq, "PENDING"), spec.output)
    try:
        if spec.model_type == "rule_model":
            rule_sources.check_patterns(spark, [p for ps in spec.rules.values() for p in ps])
        rules = load_rules(spark, spec)
        posts = read_posts(spark, spec.site, spec.start, spec.end, spec.compat_slices) if posts is None else posts
        results_path, prod_path = f"{spec.output}/results", f"{spec.output}/production"
        for i, part in enumerate(batches(spec)):
            if part.end <= at:
                continue
            at = part.start
            matched = labelled_posts(posts, part, source_map, True, rules)
            tables.write_task(slice_results(matched, part, rules, ["source"]), results_path, spec.task_id, i, placed=True)
        written = tables.task_rows(tables.read_results(spark, results_path), spec.task_id)
        tables.write_task(production_rows(written, spec, rules, ["source"]), prod_path, spec.task_id, placed=True)
        prod = tables.task_rows(tables.read_results(spark, prod_path), spec.task_id)

        # No label is computed for these columns.  Sites of no source count as received, under no source.
        routed = received_posts(posts, spec).join(source_map, "s_id", "left")
        author = F.concat_ws("_", "s_id", "author").alias(AUTHOR)
        seen = (trimmed(routed.select("source", author)).groupBy("source")
                .agg(F.count("*").alias("n_received"), F.count_distinct(AUTHOR).alias("uniq_authors")))
        out = (seen.join(written.groupBy("source").agg(F.count("*").alias("n_labelled")), "source", "left")
                   .join(prod.groupBy("source").agg(F.count("*").alias("prod_rows")), "source", "left")
                   .fillna(0, ["n_labelled", "prod_rows"])
                   .withColumn("rate", metrics.rate(F.col("prod_rows"), F.col("uniq_authors"))))
        # One row per source: the figures of the audit row.
        figures = [r.asDict() for r in out.orderBy("source").collect()]
    except Exception as e:
        append_audit(audit_row(spark, spec, seq + 1, "FAILURE", error_message=str(e), check_point=at), spec.output)
        raise
    received = sum(f["n_received"] for f in figures)
    figures = [f for f in figures if f["source"] is not None]
    labelled = [f for f in figures if f["n_labelled"]]
    append_audit(audit_row(
        spark, spec, seq + 1, "SUCCESS", prod_stat="finish" if labelled else "no_data",
        length_receive_table=received,
        length_output_table=sum(f["n_labelled"] for f in figures),
        sources=[(f["source"], f["uniq_authors"], f["prod_rows"], f["rate"]) for f in labelled],
        run_time=(time.time() - began) / 60), spec.output)
    schema = "source string, n_received long, uniq_authors long, n_labelled long, prod_rows long, rate double"
    return spark.createDataFrame([tuple(f[c.split()[0]] for c in schema.split(", ")) for f in figures], schema)


def read_audit(spark: SparkSession, output: str) -> DataFrame:
    """Audit log with the comma list of result sources that the task list shows."""
    log = spark.read.schema(schemas.AUDIT).parquet(f"{output}/audit")
    return log.withColumn("result", F.array_join(F.transform("sources", lambda s: s["source"]), ","))
