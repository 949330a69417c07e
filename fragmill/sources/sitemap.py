"""Sitemaps: a line for each entity, escaped, in order of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A file holds 50,000 addresses at most, one of which is the home page's.
MOST_IDS = 49_999
NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"


def escape(text: Column) -> Column:
    """Text as XML content or attribute."""
    for character, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(character), F.lit(entity))
    return text


def sitemap(entities: DataFrame, origin: str, updated_at: str | None = None, key: str = "entity_id", parameter: str = "entity") -> DataFrame:
    """(place, line) of the sitemap of the first MOST_IDS ids, the home page first."""
    spark = entities.sparkSession
    home, stamp = origin.rstrip("/"), f"<lastmod>{updated_at[:10]}</lastmod>" if updated_at else ""
    first = entities.select(F.col(key).cast("string").alias("id")).distinct().orderBy("id").limit(MOST_IDS)
    line = F.concat(F.lit("<url><loc>"), escape(F.concat(F.lit(f"{home}/?{parameter}="), F.col("id"))), F.lit("</loc><changefreq>weekly</changefreq><priority>0.7</priority></url>"))
    head = ['<?xml version="1.0" encoding="UTF-8"?>', f'<urlset xmlns="{NAMESPACE}">']
    around = spark.createDataFrame([(0, "", x) for x in head[:1]] + [(1, "", head[1]), (4, "", "</urlset>")], "part int, id string, line string")
    page = spark.range(1).select(F.lit(2).alias("part"), F.lit("").alias("id"), F.concat(F.lit("<url><loc>"), escape(F.lit(f"{home}/")), F.lit(f"</loc>{stamp}<changefreq>daily</changefreq><priority>1.0</priority></url>")).alias("line"))
    return around.unionByName(page).unionByName(first.select(F.lit(3).alias("part"), "id", line.alias("line")))


def write_sitemap(entities: DataFrame, path: str, origin: str, updated_at: str | None = None, **options: str) -> None:
    """One text file below path; MOST_IDS bounds it."""
    sitemap(entities, origin, updated_at, **options).orderBy("part", "id").select("line").coalesce(1).write.mode("overwrite").text(path)


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """The addresses of a written sitemap, still escaped."""
    found = F.regexp_extract("value", "<loc>(.*)</loc>", 1)
    return spark.read.text(path).select(found.alias("loc")).where("loc <> ''")
