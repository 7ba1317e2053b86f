"""The graph contract as JSON: read with a fixed schema, written from the frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SOURCE = "struct<document_id:string,filename:string,file_hash_sha256:string,page:int,text_span:string>"
SCHEMA = (
    f"contract_version string, case_id string, batch_id string, total_documents int, "
    f"entities array<struct<id:string,type:string,name:string,normalized_name:string,role:string,attributes:map<string,string>,confidence:double,source:{_SOURCE}>>, "
    f"events array<struct<id:string,type:string,title:string,source_entity:string,target_entity:string,timestamp:string,timestamp_start:string,timestamp_end:string,attributes:map<string,string>,source:{_SOURCE}>>, "
    "relationships array<struct<id:string,source_entity:string,target_entity:string,relationship_type:string,confidence:double,evidence:string>>"
)


def read_contract(spark: SparkSession, path: str) -> DataFrame:
    """Contracts from JSON files, one in each file; malformed JSON raises when it is read."""
    return spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)


def parse_contract(texts: DataFrame, column: str) -> DataFrame:
    """Contracts from JSON text; malformed JSON raises when it is read."""
    return texts.select(F.from_json(column, SCHEMA, {"mode": "FAILFAST"}).alias("c")).select("c.*")


def parts(contracts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, events and relationships with the case that each belongs to."""
    return tuple(contracts.select("case_id", F.inline(c)) for c in ("entities", "events", "relationships"))


def write_contract(contracts: DataFrame, path: str) -> None:
    """Contracts as JSON lines."""
    contracts.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
