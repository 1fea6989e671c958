"""One large JSON array of tweets, read by many tasks.

Spark's ``multiLine`` reader parses a file in one task.  Here an array file is read as
text, split like any text file.  A JSON string cannot hold a line break, so every line
starts outside of strings and its brackets and commas are known on its own.  The nesting
depth at a line is the sum of all brackets before it: within its file block by a window,
and over the blocks of a file by one row per block.  Commas at the depth of the array
separate its elements; they are counted likewise, over the brackets and commas only.  So
texts are shuffled once, by block; there the pieces of an element are put together, and
only elements that reach over a block's bounds are grouped again.  ``from_json`` parses
them.

Defined cases: an element that is no valid tweet object is one row with
``_corrupt_record``, and the others are kept (the ``multiLine`` reader gives up the whole
file).  Where the brackets of a file do not add up, depth says nothing after the fault,
so its elements are taken to start at lines that open an object with as little
indentation as any in the file: a fault costs the elements that it touches.  Empty
elements and empty files give no rows; a file that is one object and no array gives one
row.  A file without line breaks is one line, thus read by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas
from ..session import Scratch

# A string (to the line's end if it is not closed), a bracket or comma, or what is between.
TOKEN = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"?|\\|[{}\[\],]|[^"\\{}\[\],]++'
NO_MARKS = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"?|[^"{}\[\],]++'
# What is neither a bracket nor blank.
NO_BRACKETS = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"?|[^"{}\[\] \t\r\n]++'
BLOCK = ("file", "block")
BLANK = " \t\r\n"


def _depth(token) -> F.Column:
    return F.when(token.isin("{", "["), 1).when(token.isin("}", "]"), -1).otherwise(0)


def _count(marks: str, kinds: str) -> F.Column:
    return F.length(marks) - F.length(F.translate(marks, kinds, ""))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, value, marks, step, closers, indent): lines that are not blank with
    their brackets and commas, and the depth that they add."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value", F.regexp_replace("value", NO_MARKS, "").alias("marks"))
    opens = F.ltrim("value").startswith("{")
    return raw.where(F.trim("value", F.lit(BLANK)) != "").select(
        *BLOCK, "line", "value", "marks", (_count("marks", "{[") - _count("marks", "}]")).cast("long").alias("step"),
        _count("marks", "}]").alias("closers"),
        F.when(opens, F.length("value") - F.length(F.ltrim("value"))).alias("indent"))


def _before(blocks: DataFrame, column: str) -> F.Column:
    """The sum of ``column`` over the earlier blocks of the file."""
    w = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(w), F.lit(0))


def _one_value(text) -> F.Column:
    """No object or array ends before the text does (``from_json`` overlooks what follows)."""
    shape = F.translate(F.regexp_replace(text, F.lit(NO_BRACKETS), F.lit(".")), BLANK, "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("ends"))

    def step(s, t):
        after = s["depth"] + _depth(t)
        return F.struct(after.alias("depth"), (s["ends"] + F.when((after == 0) & t.isin("}", "]"), 1).otherwise(0))
                        .alias("ends"))

    brackets = F.split(F.translate(shape, ".", ""), "")
    return F.aggregate(brackets, start, step, lambda s: (s["depth"] == 0) & (
        (s["ends"] == 0) | ((s["ends"] == 1) & F.right(shape, F.lit(1)).isin("}", "]"))))


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, element, text): the elements of the JSON array in each file below ``path``."""
    scratch = Scratch(spark, "array")
    lines = _lines(spark, path)
    blocks = lines.groupBy(*BLOCK).agg(
        F.sum("step").alias("step"), F.min("indent").alias("indent"),
        F.min_by(F.substring(F.trim("value", F.lit(BLANK)), 1, 1), "line").alias("first"))
    blocks = scratch.table(blocks)
    files = blocks.groupBy("file").agg((F.sum("step") == 0).alias("whole"), F.min("indent").alias("margin"),
                                       (F.min_by("first", "block") == "[").alias("array"))
    bounds = scratch.table(blocks.withColumn("before", _before(blocks, "step")).select(*BLOCK, "before")
                           .join(files, "file"))

    earlier = W.partitionBy(*BLOCK).orderBy("line").rowsBetween(W.unboundedPreceding, -1)

    def deep(rows: DataFrame, bounds: DataFrame) -> DataFrame:
        """Lines with their depth, whether they open an element of a faulty file, and the
        number of elements that start in them."""
        rows = rows.join(bounds, list(BLOCK)).withColumn(
            "depth", F.col("before") + F.coalesce(F.sum("step").over(earlier), F.lit(0)))
        near = F.col("whole") & F.col("array") & (F.col("depth") - F.col("closers") <= 1)
        start = F.struct(F.col("depth").alias("depth"), F.lit(0).cast("long").alias("cuts"))
        cuts = F.aggregate(F.split("marks", ""), start, lambda s, t: F.struct(
            (s["depth"] + _depth(t)).alias("depth"),
            (s["cuts"] + F.when((s["depth"] == 1) & (t == ","), 1).otherwise(0)).alias("cuts")), lambda s: s["cuts"])
        fresh = ~F.col("whole") & F.coalesce(F.col("indent") == F.col("margin"), F.lit(False))
        return rows.withColumns({"near": near, "fresh": fresh.cast("long")}).withColumn(
            "cuts", F.when(F.col("near"), cuts).otherwise(F.col("fresh")))

    slim = deep(lines.drop("value"), bounds).groupBy(*BLOCK).agg(F.sum("cuts").alias("cuts"))
    slim = scratch.table(slim)
    spans = scratch.table(bounds.join(slim.withColumn("low", _before(slim, "cuts")).withColumn(
        "high", F.col("low") + F.col("cuts")).drop("cuts"), list(BLOCK)))

    # Walk over the tokens of a line near the array's depth: the texts of the elements in it,
    # the first one going on from the line before.  The array's own brackets are left out.
    def walk(state, token):
        after = state["depth"] + _depth(token)
        cut = (state["depth"] == 1) & (token == ",")
        frame = (F.least(state["depth"], after) == 0) & token.isin("[", "]")
        last = F.size(state["texts"])
        grown = F.concat(F.slice(state["texts"], 1, last - 1), F.array(
            F.concat(F.element_at(state["texts"], -1), token)))
        return F.struct(after.alias("depth"),
                        F.when(cut, F.concat(state["texts"], F.array(F.lit(""))))
                        .when(frame, state["texts"]).otherwise(grown).alias("texts"))

    start = F.struct(F.col("depth").alias("depth"), F.array(F.lit("")).alias("texts"))
    tokens = F.regexp_extract_all("value", F.lit(TOKEN), F.lit(0))
    texts = F.when(F.col("near"), F.aggregate(tokens, start, walk, lambda s: s["texts"])).otherwise(F.array("value"))
    numbered = deep(lines, spans).withColumn(
        "number", F.col("low") + F.coalesce(F.sum("cuts").over(earlier), F.lit(0)) + F.col("fresh"))
    pieces = numbered.select(*BLOCK, "line", "whole", "low", "high", "number",
                             F.posexplode(texts).alias("at", "text")).withColumn("element", F.col("number") + F.col("at"))
    parts = pieces.groupBy(*BLOCK, "element", "whole", F.col("element").isin(F.col("low"), F.col("high")).alias("edge")).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("line", "text")))["text"], "\n").alias("text"))
    # The first and the last element of a block may go on in others.
    across = parts.where("edge").groupBy("file", "element", "whole").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("block", "text")))["text"], "\n").alias("text"))
    elements = parts.where("NOT edge").select(*across.columns).unionByName(across)
    # Without depth, separators and the closing bracket are still at an element's end.
    text = F.when(F.col("whole"), F.trim("text", F.lit(BLANK))).otherwise(
        F.ltrim(F.rtrim("text", F.lit(BLANK + ",]")), F.lit(BLANK + "[")))
    return elements.select("file", "element", text.alias("text")).where("text <> ''")


def read_posts_array(spark: SparkSession, path: str) -> DataFrame:
    """Raw tweet rows with the ``schemas.TWEET`` schema, and the ``file`` they are from."""
    # Each step is a generator of one row: filters on what comes out stay above it, so an
    # element is checked and parsed once however many of its columns are asked for.
    checked = array_elements(spark, path).select("file", "text", F.explode(F.array(_one_value(F.col("text")))).alias("one"))
    parsed = F.from_json(F.when(F.col("one"), F.col("text")), schemas.TWEET,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = checked.select("file", "text", "one", F.explode(F.array(parsed)).alias("tweet"))
    own = F.when(F.col("one"), F.col("tweet._corrupt_record")).otherwise(F.col("text"))
    return rows.select("tweet.*", "file", own.alias("own")).withColumn("_corrupt_record", F.col("own")).drop("own")


def write_arrays(objects: DataFrame, path: str, files: int) -> None:
    """Write the JSON texts ``object`` as arrays, ``files`` for each ``studyId``, in the order of ``at``."""
    rows = objects.withColumn("part", F.pmod(F.xxhash64("at"), F.lit(files)))
    own = W.partitionBy("studyId", "part").orderBy("at")
    line = F.concat(F.when(F.row_number().over(own) == 1, F.lit("[\n")).otherwise(F.lit("")), F.col("object"),
                    F.when(F.lead("at").over(own).isNull(), F.lit("\n]")).otherwise(F.lit(",")))
    # The window's partitions hold whole files, in order.
    rows.select("studyId", "part", line.alias("value")).write.partitionBy("studyId", "part").text(path)
