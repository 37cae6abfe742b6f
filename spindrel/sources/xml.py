"""Stories and companies in XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import repair_text

STORY_SCHEMA = (
    "_StoryId long, _Date string, Headline string, Story_text string, Source string, "
    "Editor_Tags struct<Tag: array<struct<_OrgID: long, _Relevance: string>>>"
)
COMPANY_SCHEMA = "OrgID long, Full_Name string, Domicile string"


def read_stories(spark: SparkSession, path: str, row_tag: str = "Story_Identifier", empty: str = "None") -> DataFrame:
    """(story_id, date, headline, text, source, tags map); empty elements become ``empty``, a missing tag list an empty map."""
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(STORY_SCHEMA).load(path)
    text = lambda c: repair_text(F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(empty)))
    pairs = F.transform("Editor_Tags.Tag", lambda t: F.struct(t["_OrgID"].alias("key"), t["_Relevance"].alias("value")))
    tags = F.map_from_entries(F.coalesce(pairs, F.from_json(F.lit("[]"), "array<struct<key:bigint,value:string>>")))
    return raw.select(
        F.col("_StoryId").alias("story_id"), F.to_date("_Date", "d MMM yyyy").alias("date"), text("Headline").alias("headline"),
        text("Story_text").alias("text"), F.col("Source").alias("source"), tags.alias("tags"),
    )


def read_companies(spark: SparkSession, path: str, row_tag: str = "Company") -> DataFrame:
    """(id, name, domicile, ord); ``ord`` follows the order in the file."""
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(COMPANY_SCHEMA).load(path)
    return raw.select(
        F.col("OrgID").alias("id"), repair_text(F.col("Full_Name")).alias("name"), repair_text(F.col("Domicile")).alias("domicile"),
        F.monotonically_increasing_id().alias("ord"),
    )


def story_tags(stories: DataFrame) -> DataFrame:
    """(story_id, coid, relevance), a row for each tag."""
    return stories.select("story_id", F.explode("tags").alias("coid", "relevance"))


def write_stories(stories: DataFrame, path: str, row_tag: str = "Story_Identifier", root: str = "Stories") -> None:
    """``stories`` (story_id, date, headline, text, source, tags map) as ``read_stories`` reads them."""
    tag = F.transform(F.map_entries("tags"), lambda t: F.struct(t["key"].alias("_OrgID"), t["value"].alias("_Relevance")))
    rows = stories.select(
        F.col("story_id").alias("_StoryId"), F.date_format("date", "d MMM yyyy").alias("_Date"), F.col("headline").alias("Headline"),
        F.col("text").alias("Story_text"), F.col("source").alias("Source"), F.struct(tag.alias("Tag")).alias("Editor_Tags"),
    )
    rows.write.format("xml").option("rootTag", root).option("rowTag", row_tag).mode("overwrite").save(path)


def write_companies(companies: DataFrame, path: str, row_tag: str = "Company", root: str = "Companies") -> None:
    """``companies`` (id, name, domicile) as ``read_companies`` reads them."""
    rows = companies.select(F.col("id").alias("OrgID"), F.col("name").alias("Full_Name"), F.col("domicile").alias("Domicile"))
    rows.write.format("xml").option("rootTag", root).option("rowTag", row_tag).mode("overwrite").save(path)


def write_tags(tags: DataFrame, names: DataFrame, path: str, relevance: str = "H", root: str = "Stories") -> None:
    """Story/Tags/Tag elements of ``tags`` (story_id, coid); a tag without a company in ``names`` (id, name) is an error.

    Each part file has its own root element; the data set's name stands in the
    folder's name.
    """
    named = tags.join(names.select(F.col("id").alias("coid"), "name"), "coid", "left")
    known = F.when(F.col("name").isNull(), F.raise_error(F.concat(F.lit("no company "), F.col("coid").cast("string")))).otherwise(F.col("name"))
    tag = F.struct(F.col("coid").cast("string").alias("_OrgID"), known.alias("_Company"), F.lit(relevance).alias("_Relevance"))
    rows = named.groupBy(F.col("story_id").cast("string").alias("_StoryId")).agg(F.sort_array(F.collect_list(tag)).alias("t"))
    rows = rows.select("_StoryId", F.struct(F.col("t").alias("Tag")).alias("Tags"))
    rows.write.format("xml").option("rootTag", root).option("rowTag", "Story").mode("overwrite").save(path)


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """(story_id, coid, company, relevance) of what ``write_tags`` has written."""
    schema = "_StoryId long, Tags struct<Tag: array<struct<_OrgID: long, _Company: string, _Relevance: string>>>"
    raw = spark.read.format("xml").option("rowTag", "Story").schema(schema).load(path)
    each = raw.select(F.col("_StoryId").alias("story_id"), F.explode("Tags.Tag").alias("t"))
    return each.select("story_id", F.col("t._OrgID").alias("coid"), F.col("t._Company").alias("company"), F.col("t._Relevance").alias("relevance"))


def one_document(tags: DataFrame, names: DataFrame, path: str, dataset: str) -> None:
    """The same as one indented document with the data set's name, for results that fit on the driver."""
    from xml.etree import ElementTree as ET

    root = ET.Element("Results")
    ET.SubElement(root, "Dataset").text = dataset
    stories, elements = ET.SubElement(root, "Stories"), {}
    rows = tags.join(names.select(F.col("id").alias("coid"), "name"), "coid", "left").orderBy("story_id", "coid")
    for row in rows.toLocalIterator():
        if row["name"] is None:
            raise KeyError(row["coid"])
        if row["story_id"] not in elements:
            story = ET.SubElement(stories, "Story", {"StoryId": str(row["story_id"])})
            elements = {row["story_id"]: ET.SubElement(story, "Tags")}
        ET.SubElement(elements[row["story_id"]], "Tag", {"OrgID": str(row["coid"]), "Company": row["name"], "Relevance": "H"})
    ET.indent(root)
    with open(path, "wb") as f:
        ET.ElementTree(root).write(f, encoding="utf-8", xml_declaration=True)
