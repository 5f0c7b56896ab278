"""Trial records: XML and JSON scans, criteria, ages, first-wins dedup, and the binding to the test tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelight.functions.text import collapse
from sievelight.schema import NO_MAX_AGE

# Years of a unit; words that open an exclusion, an inclusion, and a negated item; bullets.
UNIT_YEARS = {"year": "1.0D", "month": "1.0D / 12", "week": "1.0D / 52", "day": "1.0D / 365", "hour": "1.0D / 8760", "minute": "1.0D / 525600"}
EXCLUSION_HEAD = "(?i)(?U)exclusion\\s+criteria\\s*:?"
INCLUSION_HEAD = "(?i)(?U)^\\s*inclusion\\s+criteria\\s*:?"
BULLET = "(?U)\\s+-\\s+|\\s+\\*\\s+|\\s+\\d{1,2}[.)]\\s+"
NEGATED = "(?i)(?U)^\\s*(?:no|not|must not|without|absence of|none of|patients? (?:with|who have) no)\\b\\s*"

XML_SCHEMA = """
id_info struct<nct_id: string>, brief_title string, official_title string,
brief_summary struct<textblock: string>, detailed_description struct<textblock: string>,
condition array<string>, keyword array<string>, condition_browse struct<mesh_term: array<string>>,
intervention array<struct<intervention_name: string>>, intervention_browse struct<mesh_term: array<string>>,
eligibility struct<criteria: struct<textblock: string>, gender: string, minimum_age: string, maximum_age: string>,
overall_status string, phase string, study_type string
"""


def age_years(text: Column, default: float) -> Column:
    """Years of texts like ``6 Months`` (three decimals); unknown units count as years, anything else gives the default."""
    low = F.lower(F.coalesce(text, F.lit("")))
    form = "(?U)^\\s*([\\d.]+)\\s*([a-z]+)"
    unit = F.regexp_replace(F.regexp_extract(low, form, 2), "s+$", "")
    scale = F.lit(1.0)
    for name, years in UNIT_YEARS.items():
        scale = F.when(unit == name, F.expr(years)).otherwise(scale)
    return F.when(low.rlike(form), F.round(F.regexp_extract(low, form, 1).try_cast("double") * scale, 3)).otherwise(F.lit(default))


def in_ascii(form: str) -> str:
    """The expression as RE2 reads it: white space, digits and ends of words are those of ASCII, and a long s is an s."""
    for a, b in (("(?U)", ""), ("\\s", "[\\t\\n\\f\\r ]"), ("\\d", "[0-9]"), ("\\b", "(?![0-9A-Za-z_])")):
        form = form.replace(a, b)
    return re.sub("(?<!\\\\)s", "[s\u017f]", form)


def split_criteria(text: Column, plain: bool = False) -> tuple[Column, Column]:
    """(inclusion, exclusion) of a criteria text.

    What follows the first exclusion header is exclusion; inclusion items that
    begin with a negation go there too, without the negation.  ``plain`` reads as
    DuckDB's SQL does: in ASCII (a "No" before a letter that is not ASCII is a word),
    and the exclusion ends at a second header.
    """
    exclusion_head, inclusion_head, bullet, negated = (in_ascii(x) if plain else x for x in (EXCLUSION_HEAD, INCLUSION_HEAD, BULLET, NEGATED))
    parts = F.split(text, exclusion_head, -1 if plain else 2)
    items = F.split(F.regexp_replace(parts[0], inclusion_head, ""), bullet, -1)
    kept = F.filter(items, lambda x: ~x.rlike(negated))
    moved = F.transform(F.filter(items, lambda x: x.rlike(negated)), lambda x: F.regexp_replace(x, negated, ""))
    after = F.trim(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")))
    return F.trim(F.array_join(kept, " ")), F.trim(F.array_join(F.concat(F.array(after), moved), " "))


def has_header(text: Column) -> Column:
    return text.rlike(EXCLUSION_HEAD)


def read_zips(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(part, entry, xml) of the XML files in ZIP archives, one task an archive."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def unzip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for i, name in enumerate(z.namelist()):
                        if name.endswith(".xml"):
                            yield pd.DataFrame({"part": [path], "entry": [i], "xml": [z.read(name).decode("utf-8", "replace")]})

    return files.mapInPandas(unzip, "part string, entry bigint, xml string")


def parse_xml(records: DataFrame, xml: str = "xml") -> DataFrame:
    """The 15 fields of each record (and the input's other columns); malformed XML and records without an id go."""
    r = records.withColumn("r", F.from_xml(xml, XML_SCHEMA)).where(F.col("r").isNotNull())
    text = lambda path: F.coalesce(collapse(F.col(f"r.{path}")), F.lit(""))
    empty = F.array().cast("array<string>")

    def many(*paths: str) -> Column:
        found = F.concat(*[F.coalesce(F.col(f"r.{p}"), empty) for p in paths])
        return F.filter(F.transform(found, lambda x: collapse(F.coalesce(x, F.lit("")))), lambda x: x != "")

    inclusion, exclusion = split_criteria(text("eligibility.criteria.textblock"))
    gender = text("eligibility.gender")
    fields = {
        "id": text("id_info.nct_id"), "title": text("brief_title"), "official": text("official_title"), "summary": text("brief_summary.textblock"),
        "description": text("detailed_description.textblock"), "conditions": many("condition", "keyword", "condition_browse.mesh_term"),
        "interventions": many("intervention.intervention_name", "intervention_browse.mesh_term"), "inclusion": inclusion, "exclusion": exclusion,
        "gender": F.when(gender.isin("Male", "Female"), gender).otherwise("All"),
        "min_age": age_years(F.col("r.eligibility.minimum_age"), 0.0), "max_age": age_years(F.col("r.eligibility.maximum_age"), NO_MAX_AGE),
        "status": text("overall_status"), "phase": text("phase"), "type": text("study_type"), "criteria": text("eligibility.criteria.textblock"),
    }
    others = [c for c in records.columns if c != xml]
    return r.select(*others, *[v.alias(k) for k, v in fields.items()]).where(F.col("id") != "")


def criteria_stats(criteria: DataFrame, text: str = "criteria", plain: bool = False) -> DataFrame:
    """Counts of records, criteria, headers, moved items and exclusions, in one pass."""
    _, exclusion = split_criteria(F.col(text), plain)
    header = has_header(F.col(text))
    return criteria.agg(
        F.count(F.lit(1)).alias("trials"), F.count_if(F.col(text) != "").alias("criteria"), F.count_if(header).alias("header"),
        F.count_if((exclusion != "") & ~header).alias("moved"), F.count_if(exclusion != "").alias("exclusion"),
    )


def dedup_first(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first record of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return records.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def with_ordinals(records: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``doc``, 0, 1, .. in the given order, without moving all rows to one task.

    Rows are range-partitioned and sorted, counted by partition, and numbered from
    their partition's offset; the table of counts has a row a partition.
    """
    placed = records.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__n", F.monotonically_increasing_id())
    sizes = placed.groupBy("__part").agg(F.min("__n").alias("__first"), F.count(F.lit(1)).alias("__count"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__offset", F.coalesce(F.sum("__count").over(before), F.lit(0)))
    joined = placed.join(F.broadcast(sizes.drop("__count")), "__part")
    return joined.withColumn("doc", (F.col("__n") - F.col("__first") + F.col("__offset")).cast("bigint")).drop("__part", "__n", "__first", "__offset")


def write_json(records: DataFrame, path: str, key: str = "id", order: tuple[str, ...] = ("doc",)) -> None:
    """Merges records (the first of each key, in ``order``) into JSON lines by the fixed schema."""
    from sievelight.schema import TRIAL

    names = [c.strip().split(" ")[0] for c in TRIAL.split(", ")]
    dedup_first(records, key, list(order)).select(*names).write.mode("overwrite").json(path)


def lookup(records: DataFrame, docs: DataFrame, *columns: str) -> DataFrame:
    """The records of given documents, of the named columns; the asked-for side is small, so Spark broadcasts it."""
    return records.select("doc", *columns).join(docs, "doc")


def to_xml(trials: DataFrame) -> DataFrame:
    """(doc, xml): records in the XML form that ``parse_xml`` reads."""
    block = lambda c: F.struct(F.col(c).alias("textblock"))
    years = lambda c: F.concat(F.col(c).cast("string"), F.lit(" Years"))
    eligibility = F.struct(F.struct(F.concat(F.lit("Inclusion Criteria: "), "inclusion", F.lit(" Exclusion Criteria: "), "exclusion").alias("textblock")).alias("criteria"), F.col("gender"), years("min_age").alias("minimum_age"), years("max_age").alias("maximum_age"))
    record = F.struct(
        F.struct(F.col("id").alias("nct_id")).alias("id_info"), F.col("title").alias("brief_title"), F.col("official").alias("official_title"),
        block("summary").alias("brief_summary"), block("description").alias("detailed_description"), F.col("conditions").alias("condition"),
        F.transform("interventions", lambda x: F.struct(x.alias("intervention_name"))).alias("intervention"), eligibility.alias("eligibility"),
    )
    return trials.select("doc", F.to_xml(record).alias("xml"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records written as JSON lines, by the fixed schema."""
    from sievelight.schema import TRIAL

    return spark.read.schema(TRIAL).json(path)


def from_documents(documents: DataFrame) -> DataFrame:
    """The test tables' binding: lines of a document are a record's zones.

    Lines 1 to 6 are title, conditions (by commas), summary, interventions (by
    commas), inclusion, exclusion, and the others the description; language gives
    the gender and n_chars a synthetic age range.
    """
    lines = F.split(F.col("text"), "\n", -1)
    line = lambda i: F.coalesce(F.try_element_at(lines, F.lit(i + 1)), F.lit(""))
    items = lambda i: F.split(line(i), ",", -1)
    low = (F.col("n_chars") % 60).cast("double")
    return documents.select(
        F.col("doc_id").alias("doc"), F.col("doc_id").cast("string").alias("id"), line(0).alias("title"), F.lit("").alias("official"), line(2).alias("summary"),
        F.array_join(F.slice(lines, 7, F.greatest(F.size(lines), F.lit(1))), " ").alias("description"), items(1).alias("conditions"), items(3).alias("interventions"),
        line(4).alias("inclusion"), line(5).alias("exclusion"), F.when(F.col("lang") == "de", "Male").when(F.col("lang") == "fr", "Female").otherwise("All").alias("gender"),
        low.alias("min_age"), (low + 40).alias("max_age"), F.lit("").alias("status"), F.lit("").alias("phase"), F.lit("").alias("type"),
    )
