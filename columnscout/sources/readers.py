"""Readers of lakes: folders of CSV files, JDBC databases, the session's catalogue, and parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from columnscout.sources.config import reader


def _files(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(name, path) of the files and parquet folders in a folder of any file system, not recursive, hidden ones left out."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(where)]
    return sorted((n, p) for n, p in found if not n.startswith((".", "_")))


@reader("csv")
def csv_folder(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """Every file of a folder is a relation of its name, with a header row; all cells are strings.

    Rows of another width than the header are dropped, whichever columns a query reads; so are clashing header names told apart by a number. Settings: path, separator (one
    character), encoding.
    """
    out = {}
    for name, path in _files(spark, config["path"]):
        df = spark.read.option("header", True).option("sep", config.get("separator", ",")).option("encoding", config.get("encoding", "UTF-8"))
        out[name] = df.option("mode", "DROPMALFORMED").option("inferSchema", False).option("columnPruning", False).csv(path)
    return out


@reader("parquet")
def parquet_folder(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """Every parquet file or folder of a folder is a relation, named without its ending. Settings: path, tables (optional list)."""
    wanted = config.get("tables")
    return {n.removesuffix(".parquet"): spark.read.parquet(p) for n, p in _files(spark, config["path"]) if n.endswith(".parquet") and (wanted is None or n.removesuffix(".parquet") in wanted)}


#: Driver class and URL of each kind of database.
JDBC = {
    "postgres": ("org.postgresql.Driver", "jdbc:postgresql://{host}:{port}/{database}"),
    "sqlserver": ("com.microsoft.sqlserver.jdbc.SQLServerDriver", "jdbc:sqlserver://{host}:{port};databaseName={database}"),
    "hive": ("org.apache.hive.jdbc.HiveDriver", "jdbc:hive2://{host}:{port}/{database}"),
    "mysql": ("com.mysql.cj.jdbc.Driver", "jdbc:mysql://{host}:{port}/{database}"),
    "oracle": ("oracle.jdbc.OracleDriver", "jdbc:oracle:thin:@{host}:{port}:{database}"),
}
#: The query that lists tables and views of each kind.
LISTING = {
    "postgres": "select table_name from information_schema.tables where table_schema = current_schema() and table_type in ('BASE TABLE', 'VIEW')",
    "sqlserver": "select table_name from information_schema.tables where table_type in ('BASE TABLE', 'VIEW')",
    "mysql": "select table_name from information_schema.tables where table_schema = database()",
    "oracle": "select table_name from user_tables union all select view_name from user_views",
}


def jdbc_options(kind: str, config: dict) -> dict[str, str]:
    """Options of Spark's JDBC source. Settings: host, port, database, user, password, fetch_size, options."""
    driver, url = JDBC[kind]
    return {"driver": driver, "url": url.format(**config), "fetchsize": str(config.get("fetch_size", 10_000)),
            **{k: str(config[k]) for k in ("user", "password") if k in config}, **config.get("options", {})}


def as_strings(df: DataFrame) -> DataFrame:
    """Every column as a string, null as the empty string, as profiled databases are read."""
    return df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns))


def _jdbc(kind: str):
    @reader(kind)
    def read(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
        options = jdbc_options(kind, config)
        names = config.get("tables") or [r[0] for r in spark.read.format("jdbc").options(**options).option("query", LISTING[kind]).load().collect()]
        # a table's partition column, if named, lets executors read it in parallel
        split = config.get("partition", {})
        return {n: as_strings(spark.read.format("jdbc").options(**options, **split.get(n, {})).option("dbtable", n).load()) for n in names}
    return read


for _kind in ("postgres", "sqlserver", "mysql", "oracle"):
    _jdbc(_kind)


@reader("hive")
def session_catalogue(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """Tables and views of a database of the session's catalogue. Settings: database."""
    db = config.get("database") or spark.catalog.currentDatabase()
    return {t.name: spark.table(f"`{t.name}`" if t.isTemporary else f"`{db}`.`{t.name}`") for t in spark.catalog.listTables(db)}
