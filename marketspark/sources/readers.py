"""Readers. Schemas are always given, never inferred, so a scan reads only what a job selects."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

TRANSACTIONS = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("procedure_id", T.IntegerType()),
        T.StructField("trans_group_id", T.IntegerType()),
        T.StructField("trans_group_en", T.StringType()),
        T.StructField("instance_date", T.StringType()),
        T.StructField("property_type_en", T.StringType()),
        T.StructField("property_sub_type_en", T.StringType()),
        T.StructField("reg_type_en", T.StringType()),
        T.StructField("area_name_en", T.StringType()),
        T.StructField("project_name_en", T.StringType()),
        T.StructField("master_project_en", T.StringType()),
        T.StructField("nearest_metro_en", T.StringType()),
        T.StructField("nearest_mall_en", T.StringType()),
        T.StructField("nearest_landmark_en", T.StringType()),
        T.StructField("rooms_en", T.StringType()),
        T.StructField("has_parking", T.IntegerType()),
        T.StructField("procedure_area", T.DoubleType()),
        T.StructField("actual_worth", T.DoubleType()),
        T.StructField("meter_sale_price", T.DoubleType()),
        T.StructField("rent_value", T.DoubleType()),
    ]
)

# Columns of the supply list file and their names in the library.
SUPPLY_COLUMNS = {
    "ID": "project_id",
    "Project_Name": "project_name",
    "Emirate": "emirate",
    "Master_Development": "master_development",
    "Sub_Location_1": "sub_location_1",
    "Sub_Location_2": "sub_location_2",
    "Sub_Location_3": "sub_location_3",
    "Developer": "developer",
    "Developer_Property_Type": "developer_property_type",
    "Status": "status",
    "Launch_Date": "launch_date",
    "Initial_Completion_Date": "initial_completion_date",
    "Actual_Completion_Date": "actual_completion_date",
    "Completion_Month": "completion_month",
    "Completion_Year": "completion_year",
    "Total_Units": "total_units",
    "Total_Apartments": "total_apartments",
    "Total_Hotel_Apartments": "total_hotel_apartments",
    "total_Serviced_Apartments": "total_serviced_apartments",
    "Total_Townhouses": "total_townhouses",
    "Total_Villas": "total_villas",
    "Total_Offices": "total_offices",
    "Total_Retails": "total_retails",
    "Total_Hotel_Rooms": "total_hotel_rooms",
    "Completion_Percentage": "completion_percentage",
    "Title_Type": "title_type",
    "Location": "location_address",
    "Height_Class": "height_class",
}
SUPPLY_COUNTS = [c for c in SUPPLY_COLUMNS if c.lower().startswith("total_") or c.startswith("Completion_")]

SEARCH_ROWS = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("page", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("clicks", T.LongType()),
        T.StructField("impressions", T.LongType()),
        T.StructField("ctr", T.DoubleType()),
        T.StructField("position", T.DoubleType()),
    ]
)


# How transaction lines are read: 'null' is NULL and a malformed line fails the load.
TRANSACTIONS_CSV = {"nullValue": "null", "mode": "FAILFAST"}
SUPPLY_CSV = T.StructType([T.StructField(c, T.DoubleType() if c in SUPPLY_COUNTS else T.StringType()) for c in SUPPLY_COLUMNS])


def read_transactions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Transactions file with a header; 'null' is NULL and a malformed row fails the load."""
    return spark.read.schema(TRANSACTIONS).option("header", True).options(**TRANSACTIONS_CSV).csv(path)


def parse_transactions(lines: DataFrame, line: str = "line") -> DataFrame:
    """The same for lines that stand in a column, as they come from a stream or a message table."""
    return lines.select(F.from_csv(line, TRANSACTIONS.simpleString()[len("struct<"):-1].replace(":", " "), TRANSACTIONS_CSV).alias("t")).select("t.*")


def read_warehouse(
    spark: SparkSession, path: str, columns: list[str], year: int | None = None, source_format: str = "parquet", limit: int | None = None,
    day: str | None = None,
) -> DataFrame:
    """Columns and one year of a warehouse table; both reach the scan. Newest rows first if limited.

    The year is that of the column Year, or of the date column `day` where the table has no such column.
    """
    df = spark.read.format(source_format).load(path)
    if year is not None:
        within_year = (F.col("Year") == year) if day is None else (F.col(day) >= F.lit(f"{year}-01-01")) & (F.col(day) < F.lit(f"{year + 1}-01-01"))
        df = df.where(within_year)
    df = df.select(*columns)
    return df if limit is None else df.orderBy(F.desc("evidence_date"), "id").limit(limit)


def read_supply_csv(spark: SparkSession, path: str) -> DataFrame:
    """Supply list file (Latin-1, 28 columns) under the library's column names."""
    return named_supply(spark.read.schema(SUPPLY_CSV).option("header", True).option("encoding", "ISO-8859-1").csv(path))


def parse_supply(lines: DataFrame, line: str = "line") -> DataFrame:
    """The same for lines that stand in a column."""
    return named_supply(lines.select(F.from_csv(line, SUPPLY_CSV.simpleString()[len("struct<"):-1].replace(":", " ")).alias("t")).select("t.*"))


def named_supply(raw: DataFrame) -> DataFrame:
    """The file's columns under the library's names, with whole counts."""
    counts = {SUPPLY_COLUMNS[c] for c in SUPPLY_COUNTS}
    named = raw.withColumnsRenamed(SUPPLY_COLUMNS)
    return named.withColumns({c: F.col(c).cast("int") for c in counts})


def read_search_rows(
    spark: SparkSession, path: str, source_format: str = "parquet", page_contains: str | None = None, page: str | None = None
) -> DataFrame:
    """Landed search-performance rows, optionally of one page or of pages containing a text."""
    return picked_search_rows(spark.read.schema(SEARCH_ROWS).format(source_format).load(path), page_contains, page)


def picked_search_rows(df: DataFrame, page_contains: str | None = None, page: str | None = None) -> DataFrame:
    """Search rows of one page or of pages containing a text."""
    if page is not None:
        df = df.where(F.col("page") == page)
    if page_contains is not None:
        df = df.where(F.col("page").contains(page_contains))
    return df


def source_profile(df: DataFrame, day: str, kind: str, area: str) -> DataFrame:
    """Row count and date range, rows per type and rows of the ten largest areas, as (section, key, value)."""
    rows = F.count(F.lit(1))
    overall = df.agg(rows.alias("n"), F.min(day).alias("first"), F.max(day).alias("last"))
    facts = overall.select(
        F.lit("overall").alias("section"),
        F.explode(
            F.create_map(
                F.lit("rows"), F.col("n").cast("string"),
                F.lit("first_date"), F.col("first").cast("string"),
                F.lit("last_date"), F.col("last").cast("string"),
            )
        ).alias("key", "value"),
    )
    kinds = df.groupBy(kind).agg(rows.alias("n")).select(F.lit("type").alias("section"), F.col(kind).alias("key"), F.col("n").cast("string").alias("value"))
    top = df.groupBy(area).agg(rows.alias("n")).orderBy(F.desc("n"), area).limit(10)
    areas = top.select(F.lit("area").alias("section"), F.col(area).alias("key"), F.col("n").cast("string").alias("value"))
    return facts.unionByName(kinds).unionByName(areas)


def column_catalog(df: DataFrame) -> DataFrame:
    """Names and types of a source's columns."""
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column_name string, data_type string")


def open_bucketed(spark: SparkSession, name: str, path: str, keys: list[str], buckets: int = 64) -> DataFrame:
    """Names the files of sinks.bucketed_table, with the keys and buckets they were written by, in the catalog of this session."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    by = ", ".join(f"`{k}`" for k in keys)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


# The pointer of a table written by sinks.commit_table: its rows name the snapshots in the order of their numbers.
POINTER = "_pointer"
POINTER_SCHEMA = "number long, snapshot string, committed_at timestamp"


def latest_snapshot(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Number and folder name of the current snapshot of a table; 0 and None where there is none yet."""
    try:
        rows = spark.read.schema(POINTER_SCHEMA).parquet(f"{path}/{POINTER}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, None
    last = rows.agg(F.max(F.struct("number", "committed_at", "snapshot")).alias("last")).first().last
    return (last.number, last.snapshot) if last else (0, None)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The current snapshot of a table that sinks.commit_table wrote."""
    name = latest_snapshot(spark, path)[1]
    if name is None:
        raise FileNotFoundError(f"no committed table at {path}")
    return spark.read.parquet(f"{path}/{name}")
