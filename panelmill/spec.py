"""One typed description of a labelling job."""

import json
from dataclasses import dataclass, field
from datetime import datetime

from panelmill.constants import MODEL_TYPES, POST_TABLE
from panelmill.functions.text import target_name


@dataclass(frozen=True)
class JobSpec:
    task_id: str
    start: datetime
    end: datetime
    rules: dict = field(default_factory=dict)     # label -> patterns, or (keyword, match type) pairs
    model_type: str = "keyword_model"
    target: str = "author_name"
    case_sensitive: bool = False
    site: dict = field(default_factory=dict)      # see sources.posts.read_posts
    output: str = ""                              # folder of the result, production and audit tables
    input_name: str = POST_TABLE
    compat_slices: bool = False                   # slices closed at both ends, short tail not read
    tie: str = "drop"                             # or "first_dropped", see operators.clean
    na_label: str | None = None                   # label of posts that a term dictionary leaves without one
    model_path: str = ""                          # stored term dictionary or forest, instead of rules
    source_map: str = ""                          # CSV source_id,table; see sources.rules.read_source_map
    batch_slices: int | None = None               # slices labelled and written at once; None: all

    def __post_init__(self):
        if self.start >= self.end:
            raise ValueError("the start of the date range must precede its end")
        if self.model_type not in MODEL_TYPES:
            raise ValueError(f"unknown model type {self.model_type!r}, expected one of {MODEL_TYPES}")
        target_name(self.target)

    @property
    def date_range(self) -> str:
        return f"{self.start} - {self.end}"

    @staticmethod
    def from_json(task_id: str, text: str, output: str = "") -> "JobSpec":
        d = json.loads(text)

        def when(s):
            return datetime.fromisoformat(s)

        pattern = {k: [tuple(v) if isinstance(v, list) else v for v in vs]
                   for k, vs in (d.get("PATTERN") or {}).items()}
        return JobSpec(task_id=task_id, start=when(d["START_TIME"]), end=when(d["END_TIME"]),
                       rules=pattern, model_type=d.get("MODEL_TYPE", "keyword_model"),
                       target=d.get("PREDICT_TYPE", "author_name"), site=d.get("SITE_CONFIG") or {},
                       input_name=d.get("INPUT_TABLE") or POST_TABLE,
                       output=output or d.get("OUTPUT_SCHEMA") or "", case_sensitive=bool(d.get("CASE_SENSITIVE")),
                       na_label=d.get("NA_TAG"), model_path=d.get("MODEL_PATH") or "",
                       source_map=d.get("SOURCE_MAP") or "", batch_slices=d.get("BATCH_SLICES"))
