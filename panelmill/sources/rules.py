"""Reading labelling rules and small dimension tables."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill import constants, schemas
from panelmill.session import fixed_table

# Above this many rules they stay a table (see operators.rule_join) instead of literals of the plan.
MAX_INLINE_RULES = 100_000


def read_keyword_file(spark: SparkSession, path: str, label: str) -> DataFrame:
    """One label's keyword file: lines ``keyword<TAB>match_type``."""
    return (spark.read.csv(path, sep="\t", schema="keyword string, match_type string", quote="")
                 .select(F.lit(label).alias("label"), "keyword", "match_type"))


def read_rule_dir(spark: SparkSession, root: str, target: str) -> DataFrame:
    """Files ``<root>/<label>/<target>.txt`` of all labels in one read; the folder is the label.
    ``target`` may also be a folder of part files of that name."""
    files = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt")
                  .csv(root, sep="\t", schema="keyword string, match_type string", quote="")
                  .select("*", F.col("_metadata.file_path").alias("_path")))
    name = target.replace(".", r"\.")
    label = F.regexp_extract("_path", rf"/([^/]+)/{name}\.txt(?:/[^/]+)?$", 1)
    return (files.withColumn("label", F.url_decode(label)).where("label <> ''")
                 .select("label", "keyword", "match_type"))


def rules_of_job(table: DataFrame, job_id: int, label: str) -> DataFrame:
    """Rules of one job of a rule table (labeling_job_id, content, match_type)."""
    return (table.where(F.col("labeling_job_id") == job_id)
                 .select(F.lit(label).alias("label"), F.col("content").alias("keyword"), "match_type"))


def rule_lists(rules: DataFrame, regex: bool = False) -> DataFrame:
    """label -> list of patterns, or of (keyword, match_type), in a fixed order.

    A list holds the rules of one label of a labelling job, not data rows.
    """
    item = F.col("keyword") if regex else F.struct("keyword", "match_type")
    return rules.groupBy("label").agg(F.array_sort(F.collect_list(item)).alias("rules"))


def merge_rules(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Rules of two jobs; a label of ``later`` replaces the same label of ``earlier``."""
    kept = earlier.join(later.select("label").distinct(), "label", "left_anti")
    return kept.unionByName(later)


def with_label_pos(rules: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Add the label's priority: its place in ``order``, or its alphabetical rank."""
    if order is not None:
        pos = F.array_position(F.lit(list(order)), F.col("label")) - 1
        return rules.withColumn("label_pos", pos.cast("int"))
    names = rules.select("label").distinct()
    ranked = names.withColumn("label_pos", F.row_number().over(Window.orderBy("label")) - 1)
    return rules.join(ranked, "label")


def inline_rules(rules: DataFrame, regex: bool = False) -> dict | None:
    """Rules as plan literals, or None if there are more than MAX_INLINE_RULES of them."""
    rows = rules.orderBy("label_pos", "keyword").limit(MAX_INLINE_RULES + 1).collect()
    if len(rows) > MAX_INLINE_RULES:
        return None
    out: dict = {}
    for r in rows:
        out.setdefault(r["label"], []).append(r["keyword"] if regex else (r["keyword"], r["match_type"]))
    return out


def keyword_rule_frame(spark: SparkSession, rules: Mapping[str, Sequence[tuple]]) -> DataFrame:
    rows = [(i, label, kw, types if isinstance(types, str) else ",".join(types))
            for i, (label, kws) in enumerate(rules.items()) for kw, types in kws]
    return spark.createDataFrame(rows, schemas.KEYWORD_RULE)


def check_patterns(spark: SparkSession, patterns: Sequence[str]) -> None:
    """Raise for a pattern the regex engine refuses, before any data is read."""
    from panelmill.functions.text import java_pattern
    one = spark.range(1)
    one.select(*[F.lit("").rlike(java_pattern(p)).alias(f"p{i}") for i, p in enumerate(patterns)]).collect()


# --- dimension tables ----------------------------------------------------------------------

def read_source_map(spark: SparkSession, path: str) -> DataFrame:
    """CSV ``source_id,table`` -> (s_id, source); a repeated id keeps its greatest table name."""
    return (spark.read.csv(path, header=True, schema="source_id string, `table` string")
                 .groupBy(F.col("source_id").alias("s_id")).agg(F.max("table").alias("source")))


def source_map(spark: SparkSession) -> DataFrame:
    rows = [(s, name) for name, sites in constants.SOURCE_SITES.items() for s in sites]
    return fixed_table(spark, rows, schemas.SOURCE_MAP)


def production_groups(spark: SparkSession) -> DataFrame:
    rows = [(s, g) for g, sources in constants.PRODUCTION_GROUPS.items() for s in sources]
    return fixed_table(spark, rows, schemas.PRODUCTION_GROUP)


# --- training files ------------------------------------------------------------------------

def read_training(spark: SparkSession, path: str, labels: Sequence[str] | None = None) -> DataFrame:
    """TSV ``content<TAB>label`` with a header line that is replaced by these names.  Quoted texts may hold line
    breaks, so a file is read by one task; large training sets come as many files."""
    df = spark.read.csv(path, sep="\t", header=True, enforceSchema=True, schema=schemas.TRAINING,
                        escape='"', multiLine=True, lineSep="\n", emptyValue="")
    return df if labels is None else df.where(F.col("label").isin(list(labels)))


def write_term_dict(terms: DataFrame, path: str) -> None:
    terms.select("label", "term", "weight").write.mode("overwrite").csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_term_dict(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schemas.TERM_DICT, escape='"')
