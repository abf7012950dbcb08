"""Queries on the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weirstone.llm import bpe, history, mix, quantiles, sentences
from weirstone.plans.reading_sql import READINGS, REPEATS
from weirstone.shared import table


def _tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [table(spark, folder, n) for n in names]


def p4_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return quantiles.p4_percentiles(*_tables(spark, folder, "samples", "stations"))


def p4_combined(spark: SparkSession, folder: str) -> DataFrame:
    return quantiles.p4_combined(*_tables(spark, folder, "samples", "stations", "windows"))


def p4_bound(spark: SparkSession, folder: str) -> DataFrame:
    return quantiles.p4_bound(*_tables(spark, folder, "samples", "stations", "windows"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return history.p6_found(*_tables(spark, folder, "samples", "stations"))


def p6_accepted(spark: SparkSession, folder: str) -> DataFrame:
    return history.p6_accepted(*_tables(spark, folder, "samples", "stations"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.p7_ids(*_tables(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return mix.p8_found(*_tables(spark, folder, "documents", "mix_targets"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix.p8_mix(*_tables(spark, folder, "documents", "mix_targets"), size="all")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix.p8_shares(*_tables(spark, folder, "documents", "mix_targets"), size="all")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.p9_found(*_tables(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p4_percentiles, p4_combined, p4_bound, p6_found, p6_accepted, p7_ids, p8_found, p8_mix, p8_shares, p9_found)}

ORACLES = {
    "p4_percentiles": f"""with {READINGS}, v as (select station_id, value, row_number() over (partition by station_id order by value) as i, count(*) over (partition by station_id) as n from r where value is not null)
        select station_id, q, n, value, cast(0 as bigint) as rank_error from v join (select unnest([0.05, 0.25, 0.5, 0.75, 0.95]::double[]) as q) on i = greatest(1, cast(ceil(q * n) as bigint))""",
    "p4_bound": f"with {READINGS}, n as (select station_id, count(*) as n from r where value is not null group by station_id) select station_id, q, n, true as holds from n cross join (select unnest([0.05, 0.25, 0.5, 0.75, 0.95]::double[]) as q)",
    "p6_found": f"with {READINGS} select sample_id from {REPEATS} x",
    "p6_accepted": f"with {READINGS} select window_id, count(*) as n_rows, count(x.sample_id) as n_repeats from samples s left join {REPEATS} x on x.sample_id = s.sample_id group by window_id",
}
