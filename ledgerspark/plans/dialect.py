"""One SQL text for two engines: the few calls that differ are written as macros.

Spark runs the text over the Parquet tables, so that column pruning and filter
pushdown reach the scans; the twin is the oracle.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: macro: (Spark, oracle); the text up to and with the opening bracket is exchanged.
CALLS = {
    "DAYNO(": ("unix_date(", "date_diff('day', DATE '1970-01-01', "),
    "PCTL(": ("percentile(", "quantile_cont("),
    "LIST(": ("collect_list(", "list("),
    "SIZE(": ("size(", "len("),
    "ISODAY(": ("1 + weekday(", "isodow("),
    "JSONTEXT(": ("get_json_object(", "json_extract_string("),
    "SORTED(": ("array_sort(", "list_sort("),
    "HEX256(": ("sha2_256(", "sha256("),
    "POSITION_IN(": ("array_position(", "list_position("),
    "SPLITBY(": ("split(", "string_split("),
    "SEQ(": ("sequence(", "generate_series("),
}


def spark_sql(text: str) -> str:
    for macro, (ours, _) in CALLS.items():
        text = text.replace(macro, ours)
    return re.sub(r"sha2_256\(((?:[^()]|\([^()]*\))*)\)", r"sha2(\1, 256)", text)


def oracle_sql(text: str) -> str:
    for macro, (_, theirs) in CALLS.items():
        text = text.replace(macro, theirs)
    return text


def runner(text: str):
    """The query function of a text. Its tables are views of names of their own, which go once the plan is made."""
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = {t: f"{t}_{uuid.uuid4().hex}" for t in used}
        for t, name in names.items():
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(name)
        try:
            return spark.sql(re.sub(rf"\b(FROM|JOIN)(\s+)({'|'.join(used)})\b", lambda m: m[1] + m[2] + names[m[3]], spark_sql(text)))
        finally:
            for name in names.values():
                spark.catalog.dropTempView(name)

    return run
