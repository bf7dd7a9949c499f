"""Sources and sinks: files with hashes, JSON lines, git logs, markdown vaults, HTML, exports, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Content types by extension.
TYPES = {"code": ["ts", "tsx", "js", "jsx", "py", "go", "rs", "java", "kt", "c", "cpp", "h", "rb", "php", "swift", "scala"], "docs": ["md", "mdx", "txt", "rst", "adoc"], "config": ["json", "yaml", "yml", "toml", "ini"]}
IGNORED = r"(?:^|/)(?:node_modules|\.git|dist|build|target|\.venv|__pycache__|coverage)(?:/|$)"


def content_type(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("other")
    for name, known in TYPES.items():
        out = F.when(extension.isin(known), name).otherwise(out)
    return out


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where a table has fewer files than those: a file of one row group is otherwise one task, however costly its rows are. Larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def files(spark: SparkSession, path: str, glob: str = "*", most_bytes: int = 1 << 20) -> DataFrame:
    """path, content, content_hash, modified_at of the files below a folder; ignored folders and files over the size stay out before they are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).filter(F.col("length") <= most_bytes).filter(~F.col("path").rlike(IGNORED))
    text = F.decode("content", "UTF-8")
    return raw.select("path", text.alias("content"), F.md5("content").alias("content_hash"), F.col("modificationTime").alias("modified_at"))


def changed_files(listing: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files whose hash isn't the one indexed."""
    return listing.join(indexed.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank and malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def front_matter(text: Column) -> Column:
    """Struct of meta (map) and body of a markdown page."""
    head = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---\n", 1)
    pairs = F.filter(F.transform(F.split(head, "\n"), lambda line: F.regexp_extract_all(line, F.lit(r"^([A-Za-z0-9_-]+):\s*(.*)$"), F.lit(0))[0]), lambda x: x.isNotNull())
    meta = F.map_from_entries(F.array_distinct(F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^([A-Za-z0-9_-]+):", 1), F.regexp_extract(p, r":\s*(.*)$", 1)))))
    return F.struct(meta.alias("meta"), F.regexp_replace(text, r"(?s)^---\n.*?\n---\n", "").alias("body"))


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and tags out, common entities decoded, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->|<[^>]+>", " ")
    for entity, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(to))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def git_log(lines: DataFrame, separator: str = "---COMMIT---") -> DataFrame:
    """commit, file from the text of one log (value): commits with 1 to 50 files, numbered from the newest."""
    logs = lines.select(F.posexplode(F.split("value", separator)).alias("commit", "body"))
    named = logs.select(F.col("commit").cast("long").alias("commit"), F.explode(F.filter(F.transform(F.split("body", "\n"), F.trim), lambda x: x != "")).alias("file")).distinct()
    sized = named.groupBy("commit").agg(F.count(F.lit(1)).alias("n")).filter("n between 1 and 50").select("commit")
    return named.join(sized, "commit", "left_semi")


def export_json(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def import_json(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}


def snapshot(tables: dict[str, DataFrame], path: str, name: str) -> None:
    """A named checkpoint of the store; an existing one isn't written over."""
    for table, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}/{table}")


def restore(spark: SparkSession, path: str, name: str, tables: list[str]) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{path}/{name}/{t}") for t in tables}


def markdown_pages(memories: DataFrame) -> DataFrame:
    """id and a page with front matter and content."""
    tags = F.array_join("tags", ", ")
    page = F.concat(F.lit("---\nid: "), F.col("id").cast("string"), F.lit("\ntype: "), F.coalesce("type", F.lit("observation")), F.lit("\ntags: "), tags, F.lit("\n---\n"), F.coalesce("content", F.lit("")))
    return memories.select("id", page.alias("page"))


def graph_json(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """kind and json of every node and edge."""
    return vertices.select(F.lit("node").alias("kind"), F.to_json(F.struct("*")).alias("json")).unionAll(edges.select(F.lit("edge"), F.to_json(F.struct("*"))))


def jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int) -> DataFrame:
    """A partitioned read of a database table."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts)
