"""Readers and writers for catalogue collections, sectioned text files and snapshot tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The collections and the names of their fields.
COLLECTIONS = ("composers", "people", "workGroups", "works", "recordings")
_ENTITY = "id string, slug string, name string, nameLatin string, country string, countries array<string>, birthYear int, deathYear int, aliases array<string>, roles array<string>, sortKey string, summary string"
SCHEMAS = {
    "composers": _ENTITY,
    "people": _ENTITY,
    "workGroups": "id string, composerId string, title string, slug string, path array<string>, sortKey string",
    "works": "id string, composerId string, groupIds array<string>, slug string, title string, titleLatin string, aliases array<string>, catalogue string, summary string, sortKey string, updatedAt string",
    "recordings": "id string, workId string, slug string, title string, sortKey string, isPrimaryRecommendation boolean, updatedAt string, credits array<struct<role:string,personId:string,displayName:string,label:string>>, links array<struct<platform:string,url:string,title:string,linkType:string,visibility:string>>",
}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_collection(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A JSON array by its declared schema; a missing file is an empty collection, a malformed one an error."""
    path, schema = f"{folder}/{name}.json", SCHEMAS[name]
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    one = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()  # one array; a folder of ours holds lines
    return spark.read.schema(schema).json(path, multiLine=one, mode="FAILFAST")


def read_library(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read_collection(spark, folder, name) for name in COLLECTIONS}


def write_library(library: dict[str, DataFrame], folder: str) -> None:
    """Writes the collections as JSON lines for read_library; composers that are people are a view of them and are not written. The folder
    must not be the one that the frames are read from."""
    for name, df in library.items():
        if name == "composers":
            df = df.join(library["people"].select("id"), "id", "left_anti")
        df.write.mode("overwrite").json(f"{folder}/{name}.json")


def sectioned(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, section, line): lines of text files under the last #section header above them."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.nullif(F.regexp_extract("line", r"^#\s*(.+?)\s*$", 1), F.lit(""))
    out = lines.withColumn("section", F.last(head, ignorenulls=True).over(w))
    return out.filter(~F.col("line").startswith("#") & (F.trim("line") != ""))


def alias_entries(lines: DataFrame) -> DataFrame:
    """(section, values): the =-separated names of each line, distinct in order."""
    parts = F.filter(F.transform(F.split("line", "="), lambda x: F.trim(x)), lambda x: (x != "") & (x != "-"))
    return lines.select("section", F.array_distinct(parts).alias("values"))


def composers_view(library: dict[str, DataFrame]) -> DataFrame:
    """People who compose stand for the composer of their id, but for the sort key where that has one; others stay as they are."""
    people = library["people"].filter(F.array_contains("roles", "composer"))
    keys = library["composers"].select("id", F.col("sortKey").alias("_own"))
    shown = people.join(keys, "id", "left").withColumn("sortKey", F.coalesce(F.nullif("_own", F.lit("")), "sortKey")).drop("_own").select(people.columns)
    return shown.unionByName(library["composers"].join(people.select("id"), "id", "left_anti"))


def named_input(df: DataFrame) -> DataFrame:
    """People and composers as they come in: old name fields folded into name and aliases, the first country as the country. Missing fields count as ''."""
    from shelfmark.functions import names

    text = lambda c: names.trimmed(F.col(c)) if c in df.columns else F.lit("")
    listed = lambda c: F.coalesce(F.col(c), names.none()) if c in df.columns else names.none()
    filled = lambda *xs: F.coalesce(*(F.nullif(x, F.lit("")) for x in xs), F.lit(""))
    short, full = filled(text("displayName"), text("name")), filled(text("displayFullName"), text("fullName"), text("name"))
    countries = names.distinct(F.concat(listed("countries"), F.array(text("country"))))
    aliases = names.distinct(F.concat(names.distinct(listed("aliases")), names.distinct(listed("abbreviations")), F.array(F.when(short != full, short).otherwise(""))))
    new = {"name": filled(full, short), "nameLatin": filled(text("nameLatin"), text("displayLatinName")), "country": names.first(countries), "countries": countries, "aliases": aliases}
    return df.withColumns(new).drop("fullName", "displayName", "displayFullName", "displayLatinName", "abbreviations")


def entity_counts(library: dict[str, DataFrame]) -> DataFrame:
    """collection, n."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("collection"), "n") for name, df in library.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def source_profiles(lines: DataFrame) -> DataFrame:
    """section, pos, url, language of sectioned lines (one file): an address a line, with an optional mark of language before it; the first
    place of each address."""
    w = Window.partitionBy("file", "url").orderBy("line_no")
    entry = lines.select("file", "line_no", "section", F.regexp_extract("line", r"^\s*\[(\w+)\]", 1).alias("language"), F.trim(F.regexp_replace("line", r"^\s*\[\w+\]\s*", "")).alias("url"))
    once = entry.filter("url <> ''").withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    return once.select("section", F.col("line_no").alias("pos"), "url", "language")


def alias_pairs(entries: DataFrame) -> DataFrame:
    """alias, other: every two names of one entry, both ways."""
    each = entries.select("values", F.explode("values").alias("alias"))
    return each.select("alias", F.explode("values").alias("other")).filter("alias <> other").distinct()


def remember(groups: DataFrame, values: list[str]) -> DataFrame:
    """groups (ord, values) with a group of names taken into the first group that shares one of them, else added at the end."""
    from shelfmark.functions import names

    new = names.distinct(F.array(*map(F.lit, values)))
    at = groups.filter(F.arrays_overlap("values", new)).agg(F.min("ord").alias("_at"), F.count("*").alias("_n"))
    grown = groups.join(F.broadcast(at)).withColumn("values", F.when(F.col("ord") == F.col("_at"), F.array_distinct(F.concat("values", new))).otherwise(F.col("values"))).select("ord", "values")
    added = at.filter("_n = 0").join(groups.agg((F.coalesce(F.max("ord"), F.lit(0)) + 1).alias("ord"))).select("ord", new.alias("values"))
    return grown.unionByName(added)


def write_run(df: DataFrame, folder: str, run_id: str) -> None:
    """A run's or a session's rows, in a partition of its own; writing it again replaces it alone."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(folder)


def list_runs(spark: SparkSession, folder: str, at: str = "createdAt") -> DataFrame:
    """run_id and time of each run, the latest first."""
    runs = spark.read.parquet(folder).groupBy(F.col("run_id").cast("string").alias("run_id")).agg(F.max(at).alias(at))
    return runs.orderBy(F.desc(at), "run_id")


def text_issues(spark: SparkSession, path: str) -> DataFrame:
    """file, issue: files that start with a byte order mark or hold a replacement character."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    marks = F.array_compact(F.array(F.when(F.hex(F.substring("content", 1, 3)) == "EFBBBF", "byte-order-mark"), F.when(F.contains(F.decode("content", "UTF-8"), F.lit("\ufffd")), "replacement-character")))
    return files.select(F.col("path").alias("file"), F.explode(marks).alias("issue"))


# The files beside the collections and the names of their fields.
SIDE = {
    "articles": "id string, slug string, title string, summary string, markdown string, showOnHome boolean, createdAt string, updatedAt string",
    "review-queue": "entityId string, entityType string, issue string, sourcePath string, note string",
    "manual-backfills": "recordingId string, removeCredits array<struct<role:string,displayName:string,personId:string>>, credits array<struct<role:string,personId:string,displayName:string,label:string>>, metadata map<string,string>, waivedMissingRoles array<string>",
}


def read_side(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the side files, a JSON array; a missing file is empty, a malformed one an error."""
    path = f"{folder}/{name}.json"
    return spark.read.schema(SIDE[name]).json(path, multiLine=True, mode="FAILFAST") if exists(spark, path) else spark.createDataFrame([], SIDE[name])


def read_person_links(spark: SparkSession, folder: str) -> DataFrame:
    """alias, canonical of a file that maps one to the other; without empty sides."""
    path = f"{folder}/person-links.json"
    if not exists(spark, path):
        return spark.createDataFrame([], "alias string, canonical string")
    text = spark.read.text(path, wholetext=True)
    held = F.from_json("value", "canonicalPersonLinks map<string,string>", {"mode": "FAILFAST"})["canonicalPersonLinks"]
    return text.select(F.explode(held).alias("alias", "canonical")).filter("alias <> '' AND canonical <> ''")


def write_artifacts(outputs: dict[str, DataFrame], folder: str) -> None:
    """One Parquet folder for each derived table, replaced as a whole."""
    for name, df in outputs.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def record_stage(payloads: DataFrame, folder: str) -> None:
    """Adds captured payloads (item_id, stage, pos, payload) to a snapshot table."""
    payloads.select("item_id", "stage", "pos", "payload").write.mode("append").partitionBy("stage").parquet(folder)


def replayed(spark: SparkSession, folder: str, items: DataFrame, stage: str) -> DataFrame:
    """item_id, payloads (in order) of a stage for the items asked for; an item without any has an empty array."""
    held = spark.read.parquet(folder).filter(F.col("stage") == stage).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", "payload"))).alias("x"))
    return items.select("item_id").join(held, "item_id", "left").select("item_id", F.coalesce(F.col("x.payload"), F.array().cast("array<string>")).alias("payloads"))
