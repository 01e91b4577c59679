"""Rule CSV in and out, and plain domain lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querytrail.functions.domains import strip
from querytrail.functions.events import is_present
from querytrail.operators.rules import API_DEFAULTS
from querytrail.schemas import RULES_CSV

# Column titles of the exchange format, and words that give a title line away.
CSV_TITLES = ["Domain", "Action", "MatchType", "Category", "Severity", "Reason"]
TITLE_WORDS = ["domain", "action", "category"]

# A semicolon followed by an even number of quotes is outside quotes.
_OPEN_SEMICOLON = r';(?=(?:[^"]*"[^"]*")*[^"]*$)'


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed non-blank lines with ``file`` and ``seq``, which rises along each file."""
    return (spark.read.text(path)
            .select(F.col("_metadata.file_path").alias("file"),
                    F.struct(F.col("_metadata.file_block_start").alias("block"),
                             F.monotonically_increasing_id().alias("row")).alias("seq"),
                    strip(F.col("value")).alias("line"))
            .filter(is_present(F.col("line"))))


def drop_title_lines(lines: DataFrame, header: bool | None = None) -> DataFrame:
    """Drop the first line of each file: always, never, or (None) when it reads like titles."""
    if header is False:
        return lines
    first = lines.groupBy("file").agg(F.min_by("line", "seq").alias("line"),
                                      F.min("seq").alias("seq"))
    if header is None:
        text = F.lower("line")
        looks: Column = F.lit(False)
        for word in TITLE_WORDS:
            looks = looks | text.contains(word)
        first = first.filter(looks)
    return lines.join(first.select("file", "seq"), ["file", "seq"], "left_anti")


def split_csv_line(line: Column) -> Column:
    """Struct of the six fields; comma or semicolon separates, quotes protect."""
    options = {"sep": ",", "quote": '"', "escape": '"', "mode": "PERMISSIVE",
               "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    return F.from_csv(F.regexp_replace(line, _OPEN_SEMICOLON, ","),
                      RULES_CSV.simpleString()[len("struct<"):-1].replace(":", " "), options)


def read_rules_csv(spark: SparkSession, path: str, header: bool | None = None) -> DataFrame:
    """CSV fields as read, with ``file`` and ``seq``; feed to ``normalize_rules_csv``."""
    lines = drop_title_lines(read_numbered_lines(spark, path), header)
    return lines.select("file", "seq", split_csv_line(F.col("line")).alias("f")).select(
        "file", "seq", "f.*")


def rules_csv_rows(rules: DataFrame) -> DataFrame:
    """The six exchange columns, blanks replaced by defaults."""
    def or_default(name: str) -> Column:
        default = API_DEFAULTS.get(name, "")
        return F.when(is_present(F.col(name)), F.col(name)).otherwise(default)
    return rules.select(*[or_default(n).alias(t)
                          for n, t in zip(RULES_CSV.names, CSV_TITLES, strict=True)])


def write_rules_csv(rules: DataFrame, path: str) -> None:
    """Every field quoted, quotes doubled, one title line per file."""
    (rules_csv_rows(rules).write.mode("overwrite").option("header", True)
     .option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path))


def read_domain_list(spark: SparkSession, path: str) -> DataFrame:
    """One domain per line: trimmed, blanks dropped, distinct."""
    return (spark.read.text(path).select(strip(F.col("value")).alias("domain"))
            .filter(is_present(F.col("domain"))).distinct())


def write_rule_snapshot(rules: DataFrame, blocked: DataFrame, root: str, version: int) -> None:
    """Publish a version: rules last, so that a version seen there is complete."""
    blocked.write.mode("overwrite").parquet(f"{root}/blocked/version={version}")
    rules.write.mode("overwrite").parquet(f"{root}/rules/version={version}")


def latest_rule_version(spark: SparkSession, root: str) -> int | None:
    from querytrail.sources.paths import is_complete, subfolders
    versions = [int(n.split("=")[1]) for n in subfolders(spark, f"{root}/rules")
                if n.startswith("version=") and is_complete(spark, f"{root}/rules/{n}")]
    return max(versions, default=None)


def read_rule_snapshot(spark: SparkSession, root: str,
                       version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rules and blocked set of the given or the latest complete version."""
    version = latest_rule_version(spark, root) if version is None else version
    if version is None:
        raise ValueError(f"no rule snapshot below {root}")
    return (spark.read.parquet(f"{root}/rules/version={version}"),
            spark.read.parquet(f"{root}/blocked/version={version}"))
