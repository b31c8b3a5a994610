"""Fixed entities: status codes, field models, log and job rows."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: code, label, whether a job stops there.
STATUSES = [("P100", "Pending", 0), ("P200", "Processing", 0), ("P300", "Analyzing", 0), ("S100", "Success", 1), ("S200", "Confirmed", 1), ("E100", "Error", 1)]
#: Which status may follow which.
NEXT = {None: ["P100"], "P100": ["P200", "E100"], "P200": ["P300", "E100"], "P300": ["S100", "E100"], "S100": ["S200"], "S200": [], "E100": []}
JOB_STATUSES = [c for c, _, _ in STATUSES if c != "S200"]
TYPES = ("string", "number", "date", "boolean", "array")
ADMINS, EDITORS = "System Admins", "Model Editors"
FIELD_DDL = "key string, label string, type string, description string"
PREVIEW_DDL = "struct<sub_documents:array<struct<index:int,page_ranges:array<int>,data:struct<guide_extracted:map<string,struct<value:string,page:int,offset:int>>,other_data:array<variant>>>>>"
LOG_DDL = f"id string, user_id string, model_id string, filename string, file_url string, status string, extracted_data variant, preview_data {PREVIEW_DDL}, error string, created_at string, updated_at string"
JOB_DDL = "id string, status string, filename string, file_url string, preview_data variant, error string, original_log_id string, log_id string, created_at string, updated_at string"


@dataclass(frozen=True)
class Field:
    key: str
    label: str
    type: str = "string"
    description: str | None = None

    def __post_init__(self):
        if self.type not in TYPES:
            raise ValueError(f"field {self.key}: no type {self.type!r}; one of {', '.join(TYPES)}")


@dataclass(frozen=True)
class ExtractionModel:
    """A name and the fields a user wants from each document."""

    name: str
    fields: tuple[Field, ...] = field(default_factory=tuple)

    def __post_init__(self):
        if len({f.key for f in self.fields}) < len(self.fields):
            raise ValueError(f"model {self.name}: a field key occurs twice")

    @staticmethod
    def from_json(text: str) -> ExtractionModel:
        raw = json.loads(text)
        return ExtractionModel(raw["model_name"], tuple(Field(f["key"], f["label"], f["type"], f.get("description")) for f in raw["fields"]))

    def to_json(self) -> str:
        return json.dumps({"model_name": self.name, "fields": [{k: v for k, v in vars(f).items() if v is not None} for f in self.fields]}, ensure_ascii=False)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(f.key, f.label, f.type, f.description) for f in self.fields], FIELD_DDL)


def status_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATUSES, "code string, label string, terminal int")
