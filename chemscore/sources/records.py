"""JSON training records -> (prompt, answer) samples.

The training file is one JSON array of ``{instruction, input, output}``
objects.  ``output`` may be a boolean, a string or null, and the answer is
Python's ``str(output)`` (``True``/``False``/``None``), so it is read as
VARIANT and rendered by its runtime type.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from chemscore.functions.text import assemble_prompt
from chemscore.operators.joins import lookup_join
from chemscore.session import materialize

# VARIANT tells a key that is absent (SQL NULL) from one that is JSON null
RECORD_DDL = "instruction VARIANT, input VARIANT, output VARIANT"
RECORDS_DDL = "array<struct<instruction:variant,input:variant,output:variant>>"


def _checked(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(keep, instruction, input, output); a record without one of its keys fails the job."""
    def present(name: str) -> Column:
        c = F.col(name)
        return F.when(c.isNull(), F.raise_error(F.lit(f"record without the key {name!r}"))).otherwise(c)

    text = lambda name: F.variant_get(present(name), "$", "string").alias(name)
    return df.select(*keep, text("instruction"), text("input"), present("output").alias("output"))


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """S1, file form: each element of the top-level array becomes a row.  One
    JSON array is one task's work; ``read_json_array_split`` reads a large one by
    many tasks.  Malformed files and absent keys fail the job."""
    raw = spark.read.schema(RECORD_DDL).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return _checked(raw, ())


def _count(text: Column, char: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("long")


def read_json_array_split(spark: SparkSession, path: str) -> DataFrame:
    """S1 for one large array per file, read by as many tasks as the file has splits.

    Files are cut at every ``}`` by the splittable text reader.  Whether a piece
    begins inside a string is the parity of the unescaped quotes before it, and
    its nesting depth is the sum of the brackets outside strings before it.
    Both are prefix sums: inside a split by a window, across splits by a table
    with one row a split.  A piece that brings the depth back to the array's own
    ends a record; a record's pieces, which may lie in several splits, are put
    together and parsed.  Malformed files and absent keys fail the job.
    """
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"))
    bare = F.regexp_replace("piece", r"(?s)\\.", "")                            # without escapes
    pieces = materialize(raw.withColumn("quotes", _count(bare, '"')), "json-pieces")
    pieces = _prefixed(pieces, "quotes").withColumn("inside", F.col("before") % 2 == 1).drop("before")
    bare = F.regexp_replace("piece", r"(?s)\\.", "")
    bare = F.when(F.col("inside"), F.concat(F.lit('"'), bare)).otherwise(bare)
    outside = F.regexp_replace(bare, r'"[^"]*("|$)', "")
    ends_inside = (F.col("quotes") + F.col("inside").cast("long")) % 2 == 1
    opened = _count(outside, "{") + _count(outside, "[") - _count(outside, "]")
    # What follows a file's last brace is a piece without one.
    pieces = pieces.withColumn("ends_inside", ends_inside).withColumn("opened", opened)
    lasts = pieces.groupBy("file").agg(F.max(F.struct("block", "at")).alias("last"))
    pieces = lookup_join(pieces, lasts, ["file"], "inner")
    last = (F.col("block") == F.col("last.block")) & (F.col("at") == F.col("last.at"))
    closes = (~F.col("ends_inside") & ~last).cast("long")
    pieces = materialize(pieces.select("file", "block", "at", "piece", last.alias("last"), "ends_inside",
                                       (F.col("opened") - closes).alias("change")), "json-depths")
    pieces = _prefixed(pieces, "change").withColumn("depth", F.col("before") + F.col("change")).drop("before")
    broken = F.col("last") & (F.col("ends_inside") | (F.col("depth") != 0))
    pieces = pieces.withColumn("ended", F.when(broken, F.raise_error(F.lit("malformed JSON array")).cast("long")).otherwise(
        (~F.col("last") & ~F.col("ends_inside") & (F.col("depth") == 1)).cast("long")))
    pieces = materialize(pieces.select("file", "block", "at", "piece", "last", "ended"), "json-ends")
    text = F.concat_ws("}", F.transform(F.sort_array(F.collect_list(F.struct("block", "at", "piece"))), lambda p: p["piece"]))
    records = _prefixed(pieces, "ended").groupBy("file", F.col("before").alias("idx")).agg(
        text.alias("text"), F.max("last").alias("tail"))
    rest = F.regexp_replace("text", r"^\s*[\[,]\s*", "")
    closing = F.regexp_replace("text", r"\s+", "")
    kept = records.where(~F.col("tail") | F.when(closing.isin("]", "[]"), F.lit(False)).otherwise(
        F.raise_error(F.lit("malformed JSON array")).cast("boolean")))
    parsed = F.from_json(F.concat(rest, F.lit("}")), RECORD_DDL.replace(" VARIANT", ": VARIANT").join(("struct<", ">")),
                         {"mode": "FAILFAST"})
    return _checked(kept.select(parsed.alias("r")).select("r.*"), ())


def _prefixed(pieces: DataFrame, column: str) -> DataFrame:
    """``before``: the sum of a column over all earlier pieces of the file."""
    totals = pieces.groupBy("file", "block").agg(F.sum(column).alias("total"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)   # a row a split
    totals = totals.select("file", "block", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return (lookup_join(pieces, totals, ["file", "block"], "inner")
            .withColumn("before", F.col("base") + F.coalesce(F.sum(column).over(inside), F.lit(0))).drop("base"))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """S1 for large inputs: one record a line, so Spark splits files over tasks.
    Malformed lines and absent keys fail the job."""
    return _checked(spark.read.schema(RECORD_DDL).option("mode", "FAILFAST").json(path), ())


def records_from_column(df: DataFrame, col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """S1, column form: a JSON array held in a string column, one row per element
    with its position ``idx``.  A malformed array or an absent key fails the
    job; a NULL column has no records."""
    arr = F.from_json(F.col(col), RECORDS_DDL, {"mode": "FAILFAST"})
    rows = df.select(*keep, F.posexplode(arr).alias("idx", "r")).select(*keep, "idx", "r.*")
    return _checked(rows, (*keep, "idx"))


@F.pandas_udf(T.StringType())
def _python_str(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else str(json.loads(v)))


def answer_to_string(output: Column, nested: bool = False) -> Column:
    """``str(output)`` for a VARIANT value: booleans render ``True``/``False``,
    null renders ``None``, strings as they are, numbers in Spark's text form.
    Lists and objects fail the job, or with ``nested`` are rendered as Python
    does (through an Arrow UDF, so only where they are expected)."""
    kind = F.schema_of_variant(output)
    as_text = F.try_variant_get(output, "$", "string")
    return (F.when(output.isNull() | (kind == F.lit("VOID")), F.lit("None"))
            .when(kind == F.lit("BOOLEAN"), F.initcap(as_text))
            .when(kind.rlike("^(ARRAY|OBJECT)"), _python_str(F.to_json(output)) if nested else F.raise_error(
                F.lit("output is a list or an object; pass nested=True")))
            .otherwise(as_text))


def to_samples(records: DataFrame, keep: tuple[str, ...] = (), nested: bool = False) -> DataFrame:
    """P1 + P2: ``prompt = [{system, instruction}, {user, input}]`` and the answer string."""
    return records.select(*keep, assemble_prompt(F.col("instruction"), F.col("input")).alias("prompt"),
                          answer_to_string(F.col("output"), nested).alias("answer"))
