"""Tabular sources and sinks.

Every sink writes partitioned output (no ``coalesce(1)``): at scale one
output file would funnel the whole table through one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# S4
def read_split_csvs(spark: SparkSession, paths: list[str], schema: T.StructType | str) -> DataFrame:
    """The three split CSV files, unioned (one scan over all paths)."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
                 .option("escape", '"').csv(paths))


# S5
_ITEM = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*["]"""


def parse_tuple_literal(col) -> Column:
    """A literal such as ``("it's", 'b')`` -> ["it's", "b"]; ``()`` -> [].
    Items may stand in either kind of quotes, backslash escapes of quotes and
    backslashes are undone.  Text that is not a tuple literal is not an array:
    the result is NULL and the caller keeps the text itself."""
    c = F.col(col) if isinstance(col, str) else col
    is_tuple = c.rlike(rf"(?s)^\s*\(\s*(?:(?:{_ITEM})\s*,\s*)*(?:(?:{_ITEM})\s*)?\)\s*$")
    quoted = F.regexp_extract_all(c, F.lit(f"({_ITEM})"), 1)
    inner = F.transform(quoted, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    items = F.transform(inner, lambda x: F.regexp_replace(x, r"""\\(['"\\])""", "$1"))
    return F.when(is_tuple, items)


# S6
def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.drop("annotation_id", "created_at").withColumn("new_id", F.col("new_id").cast("string"))


# S7
def write_selected_elements(spark: SparkSession, selected: dict[str, DataFrame], path: str) -> None:
    """One row with one array column per element kind.  Each input holds an
    ``element`` column bounded by its selection rule."""
    row = None
    for name, df in selected.items():
        col = df.agg(F.array_sort(F.collect_list("element")).alias(name))
        row = col if row is None else row.crossJoin(col)
    row.write.mode("overwrite").json(path)


def read_selected_elements(spark: SparkSession, path: str, kinds: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(k, T.ArrayType(T.StringType())) for k in kinds])
    return spark.read.schema(schema).json(path)


# S8
def write_jsonl(df: DataFrame, path: str, compression: str | None = None) -> None:
    w = df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite")
    if compression:
        w = w.option("compression", compression)
    w.text(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


# S9
LEXICON_SCHEMA = "word string, valence double, arousal double, dominance double"


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEXICON_SCHEMA).option("sep", "\t").csv(path)


# S12
def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


# S13
def write_stage(df: DataFrame, path: str) -> DataFrame:
    """Stage checkpoint: write Parquet to shared storage and read it back,
    so later stages start from the file, not the lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


# S14
def _xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def graphml_lines(nodes: DataFrame, edges: DataFrame, node_attrs: list[str],
                  edge_attrs: list[str], directed: bool = True) -> DataFrame:
    """GraphML element lines (header, one line per node and edge, footer)
    with a sort key, rendered by Spark; write with ``write_graphml``."""
    keys = [f'<key id="{a}" for="node" attr.name="{a}" attr.type="string"/>' for a in node_attrs]
    keys += [f'<key id="{a}" for="edge" attr.name="{a}" attr.type="string"/>' for a in edge_attrs]
    head = ['<?xml version="1.0" encoding="UTF-8"?>',
            '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys,
            f'<graph edgedefault="{"directed" if directed else "undirected"}">']
    spark = nodes.sparkSession

    def data(cols):
        return [F.concat(F.lit(f'<data key="{a}">'), _xml_escape(F.coalesce(F.col(a).cast("string"), F.lit(""))),
                         F.lit("</data>")) for a in cols]

    n = nodes.select(F.lit(1).alias("_part"), F.col("id").cast("string").alias("_k"),
                     F.concat(F.lit('<node id="'), _xml_escape(F.col("id").cast("string")), F.lit('">'),
                              *data(node_attrs), F.lit("</node>")).alias("value"))
    e = edges.select(F.lit(2).alias("_part"),
                     F.concat_ws("|", F.col("src").cast("string"), F.col("dst").cast("string")).alias("_k"),
                     F.concat(F.lit('<edge source="'), _xml_escape(F.col("src").cast("string")),
                              F.lit('" target="'), _xml_escape(F.col("dst").cast("string")), F.lit('">'),
                              *data(edge_attrs), F.lit("</edge>")).alias("value"))
    h = spark.createDataFrame([(0, f"{i:06d}", line) for i, line in enumerate(head)], "_part int, _k string, value string")
    f = spark.createDataFrame([(3, "0", "</graph>"), (3, "1", "</graphml>")], "_part int, _k string, value string")
    return h.unionByName(n).unionByName(e).unionByName(f)


def write_graphml(lines: DataFrame, path: str) -> None:
    """Range-sorted text output, gzip: part files concatenated in order form
    one valid document."""
    (lines.orderBy("_part", "_k").select("value")
          .write.mode("overwrite").option("compression", "gzip").text(path))


def pajek_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Pajek ``*Vertices`` / ``*Arcs`` lines; vertices numbered from 1 by the
    distributed ranking."""
    from convgraph.operators.relations import global_positions
    spark = nodes.sparkSession
    num = global_positions(nodes.select("id").distinct(), ["id"], "n")
    v = num.select(F.lit(1).alias("_part"), F.col("n").alias("_k"), F.lit(0).cast("long").alias("_k2"),
                   F.concat(F.col("n").cast("string"), F.lit(' "'), F.col("id").cast("string"), F.lit('"')).alias("value"))
    a = (edges.join(num.toDF("src", "ns"), "src").join(num.toDF("dst", "nd"), "dst")
              .select(F.lit(3).alias("_part"), F.col("ns").alias("_k"), F.col("nd").alias("_k2"),
                      F.concat_ws(" ", F.col("ns").cast("string"), F.col("nd").cast("string")).alias("value")))
    n = nodes.select("id").distinct().count()
    head = spark.createDataFrame([(0, 0, 0, f"*Vertices {n}"), (2, 0, 0, "*Arcs")],
                                 "_part int, _k long, _k2 long, value string")
    return head.unionByName(v).unionByName(a)
