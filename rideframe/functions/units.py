"""Canonical sensor names and unit transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Canonical key, synonyms, coercion, transform; the first rule that fits wins.
RULES = [
    ("hr_bpm", "hr heartrate ohr", "int", None),
    ("cad_rpm", "cad cadence", "int", None),
    ("power_w", "power watts pwr", "float", None),
    ("temp_c", "atemp temp temperature airtemp", "float", None),
    ("temp_c", "temp_f temperature_f airtemp_f", "float", "f_to_c"),
    ("speed_mps", "speed velocity", "float", None),
    ("speed_mps", "speed_kph velocity_kph kmh kph", "float", "kmh_to_mps"),
    ("speed_mps", "speed_mph velocity_mph mph", "float", "mph_to_mps"),
    ("alt_m", "alt altitude elev elevation", "float", None),
    ("grade_pct", "grade slope", "float", "fraction_to_percent"),
]

TRANSFORMS = {
    "f_to_c": lambda v: (v - 32.0) * 5.0 / 9.0,
    "kmh_to_mps": lambda v: v / 3.6,
    "mph_to_mps": lambda v: v * 0.44704,
    "fraction_to_percent": lambda v: F.when(F.abs(v) <= 1, v * 100.0).otherwise(v),
}


#: Readings over these are no rides.
CEILINGS = {"power_w": 2000.0, "cad_rpm": 200.0, "hr_bpm": 250.0}


def under_ceilings(readings: DataFrame, ceilings: dict[str, float] = CEILINGS) -> DataFrame:
    """Canonical readings whose size is at most the ceiling of their sensor; nulls and sensors without a ceiling stay."""
    over = F.lit(False)
    for name, most in ceilings.items():
        over = over | ((F.col("canonical") == name) & F.coalesce(F.abs("canonical_value") > most, F.lit(False)))
    return readings.where(~over)


def clean_key(key: Column) -> Column:
    """Trimmed, lower case, last dotted part, without a name space."""
    return F.regexp_replace(F.element_at(F.split(F.lower(F.trim(key)), "[.]"), -1), "^[^:]*:", "")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The table of a rule file {"rules": [{"canonical", "synonyms", "coerce", "transform"}]}, synonyms in lower case, the first rule of each kept."""
    rule = "rules array<struct<canonical:string,synonyms:array<string>,coerce:string,transform:string>>"
    rows = spark.read.schema(rule).option("multiLine", True).json(path).select(F.posexplode("rules").alias("i", "r")).select("i", "r", F.explode("r.synonyms").alias("s"))
    first = rows.groupBy(F.lower("s").alias("synonym")).agg(F.min_by("r", "i").alias("r"))
    return first.select("synonym", "r.canonical", "r.coerce", "r.transform")


def extension_maps(readings: DataFrame, rules: DataFrame, point: str, order: str, key: str, value: str) -> DataFrame:
    """One map of canonical names per point; of several readings of a name the first wins, unknown keys go."""
    known = canonical_readings(readings, rules, key, value).where("canonical_value is not null")
    first = known.groupBy(point, "canonical").agg(F.min_by("canonical_value", order).alias("v"))
    pairs = F.array_sort(F.collect_list(F.struct("canonical", "v")))  # as many as canonical names at most
    return first.groupBy(point).agg(F.map_from_entries(pairs).alias("extensions"))


def rules_table(spark: SparkSession) -> DataFrame:
    """(synonym, canonical, coerce, transform), one row per synonym, the first rule kept."""
    first: dict[str, tuple] = {}
    for canonical, synonyms, coerce, transform in RULES:
        for s in synonyms.split():
            first.setdefault(s, (s, canonical, coerce, transform))
    return spark.createDataFrame(list(first.values()), "synonym string, canonical string, coerce string, transform string")


def canonical_readings(readings: DataFrame, rules: DataFrame, key: str, value: str) -> DataFrame:
    """Readings whose key a rule knows, with canonical and canonical_value; other rows are dropped.

    The rules are broadcast: they are a fixed table of a few dozen synonyms.
    """
    known = readings.withColumn("clean_key", clean_key(F.col(key))).join(F.broadcast(rules), F.col("clean_key") == F.col("synonym"))
    v = F.expr(f"try_cast({value} as double)")
    out = v
    for name, f in TRANSFORMS.items():
        out = F.when(F.col("transform") == name, f(v)).otherwise(out)
    out = F.when(F.col("coerce") == "int", out.cast("long").cast("double")).otherwise(out)
    return known.withColumn("canonical_value", out).drop("synonym", "coerce", "transform")
