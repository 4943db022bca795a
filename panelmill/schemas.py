"""Schemas of the tables."""

from pyspark.sql import types as T


def _schema(**cols):
    return T.StructType([T.StructField(n, t) for n, t in cols.items()])


S, L, D, I = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType()
NTZ = T.TimestampNTZType()

POST = _schema(id=S, s_id=S, s_area_id=S, author=S, title=S, content=S, post_time=NTZ)

RESULT = _schema(id=S, task_id=S, source_author=S, panel=S, create_time=NTZ,
                 field_content=S, match_content=S)
RESULT_COLUMNS = RESULT.names

SNAPSHOT = _schema(source_author=S, panel=S, create_time=NTZ)
SNAPSHOT_COLUMNS = SNAPSHOT.names

KEYWORD_RULE = _schema(label_pos=I, label=S, keyword=S, match_type=S)
REGEX_RULE = _schema(label_pos=I, label=S, pattern_pos=I, pattern=S)
RULE_TABLE = _schema(labeling_job_id=I, content=S, match_type=S)
SOURCE_MAP = _schema(s_id=S, source=S)
PRODUCTION_GROUP = _schema(source=S, prod_group=S)
TERM_DICT = _schema(label=S, term=S, weight=D)
TRAINING = _schema(content=S, label=S)

SOURCE_METRICS = T.ArrayType(_schema(source=S, uniq_authors=L, prod_rows=L, rate=D))

# Append-only: one row per change of a task; the row with the greatest seq is its state.
AUDIT = _schema(task_id=S, seq=L, stat=S, prod_stat=S, model_type=S, predict_type=S, date_range=S,
                target_table=S, create_time=NTZ, peak_memory=T.FloatType(), length_receive_table=L,
                length_output_table=L, sources=SOURCE_METRICS, run_time=D, check_point=NTZ,
                error_message=S)

JOB_SPEC = T.StructType([
    T.StructField("MODEL_TYPE", S), T.StructField("PREDICT_TYPE", S),
    T.StructField("START_TIME", S), T.StructField("END_TIME", S),
    T.StructField("PATTERN", T.MapType(S, T.ArrayType(T.ArrayType(S)))),
    T.StructField("INPUT_SCHEMA", S), T.StructField("INPUT_TABLE", S),
    T.StructField("OUTPUT_SCHEMA", S), T.StructField("SITE_CONFIG", T.MapType(S, S)),
])
