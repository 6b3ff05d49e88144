"""The record view R: deterministic records derived from part, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

TITLES = [
    "Mechanical Engineering Technician", "Accountant", "Operations Manager", "Operations Manager: Tool and Die", "Boiler Maker (Artisan)",
    "Primary School Teacher", "Industrial Nurse", "Nurse", "Welder", "Plastics Machine Operator", "Tyre Builder", "", "Bookkeeper",
    "Mechatronic Technologist", "Mechatronic Technician", "Office Cleaner", "Motor Vehicle Mechanic", "Academic Registrar", "Payroll Clerk",
    "  Toolmaker   and  Fitter ", "Security Guard", "Production Manager", "Electrical Engineer", "Hotel Receptionist",
]
CODES = [
    "3115", "311501", "2021-311501", "1219", "2411", "7211", "721101", "6512", "", "12", "ABC", "4110", "2144", "2021-214401", "7142", "8113", "652201", "9999", "5120",
]
LEVELS = ["NQF Level 4", "5", "Level 15", "none", "NQF 10", "", "Sub 2"]
REGIONS = ["gp", "KZN", "Western Cape", "n/a", "Mars", "nw", "", "National", "lim", "free state", "EC"]
COMPANIES = ["Acme Motor Works", "Book House", "", "Tyre Plant Ltd", "Green Farm", "Metal Foundry", "City Clinic"]
COLLEGES = ["North TVET; South College; north tvet", "Orbit College", "", "  East Campus ;; West Campus ; East  Campus", "Motheo TVET", "; ;", "A College; B College; C College; A College", "Capricorn", "Lephalale TVET; Orbit College", "none", "X Academy", "South College", "Y Centre;Z Centre"]


def _pick(values: list[str], by: str) -> str:
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


#: SQL expressions that both engines read alike.
COLUMNS = {
    "row_index": "CAST(p_partkey + 1 AS BIGINT)",
    "dataset_id": "concat('ds', CAST(p_size % 4 AS VARCHAR(9)))",
    "title": _pick(TITLES, "p_partkey"),
    "ofo_code": _pick(CODES, "p_partkey"),
    "nqf": _pick(LEVELS, "p_partkey"),
    "province": _pick(REGIONS, "p_partkey"),
    "company_name": _pick(COMPANIES, "(p_partkey + p_size)"),
    "colleges": _pick(COLLEGES, "p_partkey"),
    "pk": "concat('K', CAST(p_partkey - (p_partkey % 29) * CAST(p_partkey % 3 = 0 AS INT) AS VARCHAR(19)))",
    "amount": "CASE p_partkey % 9 WHEN 0 THEN 'x' WHEN 1 THEN '' WHEN 2 THEN '12.50' WHEN 3 THEN '0042' ELSE CAST(p_size AS VARCHAR(9)) END",
}
#: The same for DuckDB, as the body of a WITH clause.
SQL = "r AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in COLUMNS.items()) + " FROM part)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey").selectExpr(*[f"{e} AS {n}" for n, e in COLUMNS.items()])
