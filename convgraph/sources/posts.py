"""Raw nested post records of two API generations.

One explicit superset ``StructType`` replaces "is this key present" tests:
an absent field reads as NULL.  Both generations are normalised by one
``select`` each and unioned by name into the common ``posts`` shape.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convgraph.functions.text import RT_PREFIX
from convgraph.sources.archives import read_archives

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()


def _st(*fields):
    return T.StructType([T.StructField(n, t) for n, t in fields])


EXTENDED = _st(("full_text", _S))
RAW_SCHEMA = _st(
    ("api", _S), ("lang", _S), ("id_str", _S), ("id", _S), ("text", _S), ("truncated", _B),
    ("created_at", _S), ("topics", T.ArrayType(_S)),
    ("extended_tweet", EXTENDED),
    ("retweeted_status", _st(("id_str", _S), ("text", _S), ("extended_tweet", EXTENDED))),
    ("quoted_status", _st(("id_str", _S), ("lang", _S), ("text", _S), ("truncated", _B),
                          ("created_at", _S), ("extended_tweet", EXTENDED))),
    ("in_reply_to_status_id_str", _S),
    ("referenced_tweets", T.ArrayType(_st(("id", _S), ("type", _S),
                                          ("tweet", _st(("text", _S), ("lang", _S), ("created_at", _S)))))),
    ("user", _st(("id", _S), ("screen_name", _S), ("username", _S), ("followers_count", _L),
                 ("statuses_count", _L), ("public_metrics", _st(("followers_count", _L), ("tweet_count", _L))))),
    ("entities", _st(("hashtags", T.ArrayType(_st(("text", _S), ("tag", _S)))),
                     ("symbols", T.ArrayType(_st(("text", _S)))),
                     ("cashtags", T.ArrayType(_st(("tag", _S)))),
                     ("user_mentions", T.ArrayType(_st(("screen_name", _S)))),
                     ("mentions", T.ArrayType(_st(("username", _S)))))),
    ("retweet_count", _L), ("reply_count", _L), ("favorite_count", _L), ("quote_count", _L),
    ("public_metrics", _st(("retweet_count", _L), ("reply_count", _L), ("like_count", _L), ("quote_count", _L))),
)

CONTEXT = T.ArrayType(_st(("context_id", _S), ("context_type", _S), ("context_text", _S),
                          ("context_created_at_time", _S)))


# S1
def read_json_dir(spark: SparkSession, path: str, skip: str = "statistics.json") -> DataFrame:
    """Pre-extracted JSON-array files; each row tagged with its file name."""
    df = (spark.read.schema(RAW_SCHEMA).option("multiLine", True).json(path)
               .withColumn("origin_file", F.col("_metadata.file_name")))
    return df.filter(F.col("origin_file") != skip)


def read_json_archives(spark: SparkSession, path: str, skip: str = "statistics.json") -> DataFrame:
    """Zip archives of JSON-array files, many tasks an archive (see
    ``sources.archives``); the records are parsed by Spark's JSON parser with
    the fixed schema."""
    recs = read_archives(spark, path, skip)
    return recs.select(F.from_json("record", RAW_SCHEMA).alias("r"), "origin_file").select("r.*", "origin_file")


def _rt(col: Column) -> Column:
    # Anchored at the start of the text
    return col.rlike("^" + RT_PREFIX)


def _names(arr: Column, field: str) -> Column:
    # Entity arrays default to []
    return F.coalesce(F.transform(arr, lambda x: x[field]), F.array().cast("array<string>"))


# S2 (+P1, P2, P4, P5, P6, P7)
def normalise_v1(raw: DataFrame) -> DataFrame:
    r = raw.filter((F.col("api") == "v1") & (F.col("lang") == "en"))
    text = (F.when(F.col("truncated") == True, F.col("extended_tweet.full_text"))  # noqa: E712
             .when(F.col("retweeted_status").isNotNull(),
                   F.coalesce(F.col("retweeted_status.extended_tweet.full_text"), F.col("retweeted_status.text")))
             .otherwise(F.col("text")))
    is_rt = _rt(F.col("text")) | F.col("retweeted_status").isNotNull()
    q = F.col("quoted_status")
    quoted = F.when(q.isNotNull() & (q["lang"] == "en"), F.struct(
        q["id_str"].alias("context_id"), F.lit("quoted").alias("context_type"),
        F.when(q["truncated"] == True, q["extended_tweet"]["full_text"]).otherwise(q["text"])  # noqa: E712
        .alias("context_text"), q["created_at"].alias("context_created_at_time")))
    reply = F.when(F.col("in_reply_to_status_id_str").isNotNull(), F.struct(
        F.col("in_reply_to_status_id_str").alias("context_id"), F.lit("replied_to").alias("context_type"),
        F.lit(None).cast("string").alias("context_text"), F.lit(None).cast("string").alias("context_created_at_time")))
    ctx = F.filter(F.array(quoted, reply), lambda x: x.isNotNull())
    return r.select(
        F.col("id_str").alias("id"), text.alias("text"), F.col("text").alias("original_text"), "created_at",
        F.col("user.id").alias("user_id"), F.col("user.screen_name").alias("username"),
        F.col("user.followers_count").alias("followers"), F.col("user.statuses_count").alias("tweet_count"),
        _names(F.col("entities.hashtags"), "text").alias("hashtags"),
        _names(F.col("entities.symbols"), "text").alias("cashtags"),
        _names(F.col("entities.user_mentions"), "screen_name").alias("mentions"),
        ctx.cast(CONTEXT).alias("context"),
        "retweet_count", "reply_count", F.col("favorite_count").alias("like_count"), "quote_count",
        is_rt.alias("is_retweet"), F.col("retweeted_status.id_str").alias("retweet_id"),
        "topics", "origin_file", "api")


# S3
def normalise_v2(raw: DataFrame) -> DataFrame:
    r = raw.filter((F.col("api") == "v2") & (F.col("lang") == "en"))
    refs = F.coalesce(F.col("referenced_tweets"), F.array().cast(RAW_SCHEMA["referenced_tweets"].dataType))
    rts = F.filter(refs, lambda x: x["type"] == "retweeted")
    has_rt = F.size(rts) > 0
    ctx = F.transform(F.filter(refs, lambda x: x["type"] != "retweeted"), lambda x: F.struct(
        x["id"].alias("context_id"), x["type"].alias("context_type"),
        F.when(x["tweet"]["lang"] == "en", x["tweet"]["text"]).alias("context_text"),
        F.when(x["tweet"]["lang"] == "en", x["tweet"]["created_at"]).alias("context_created_at_time")))
    return r.select(
        "id", F.when(has_rt, rts[0]["tweet"]["text"]).otherwise(F.col("text")).alias("text"),
        F.col("text").alias("original_text"), "created_at",
        F.col("user.id").alias("user_id"), F.col("user.username").alias("username"),
        F.col("user.public_metrics.followers_count").alias("followers"),
        F.col("user.public_metrics.tweet_count").alias("tweet_count"),
        _names(F.col("entities.hashtags"), "tag").alias("hashtags"),
        _names(F.col("entities.cashtags"), "tag").alias("cashtags"),
        _names(F.col("entities.mentions"), "username").alias("mentions"),
        ctx.cast(CONTEXT).alias("context"),
        F.col("public_metrics.retweet_count").alias("retweet_count"),
        F.col("public_metrics.reply_count").alias("reply_count"),
        F.col("public_metrics.like_count").alias("like_count"),
        F.col("public_metrics.quote_count").alias("quote_count"),
        (_rt(F.col("text")) | has_rt).alias("is_retweet"),
        F.when(has_rt, rts[0]["id"]).alias("retweet_id"),
        "topics", "origin_file", "api")


def normalise(raw: DataFrame) -> DataFrame:
    """S2 ∪ S3: one common schema for both generations."""
    return normalise_v1(raw).unionByName(normalise_v2(raw))


# P21 -- the formats seen in the two generations, tried in order
TIMESTAMP_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "MMM dd HH:mm:ss Z yyyy",
                     "yyyy-MM-dd HH:mm:ss"]


def parse_mixed_timestamp(col) -> Column:
    """Mixed-format timestamps.  The v1 form starts with a day name that
    Spark's parser rejects (``EEE``), so it is cut off first."""
    c = F.col(col) if isinstance(col, str) else col
    no_day = F.regexp_replace(c, r"^[A-Z][a-z]{2} ", "")
    return F.coalesce(*[F.try_to_timestamp(no_day, F.lit(f)) for f in TIMESTAMP_FORMATS])


# P20
def unix_seconds(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(c.cast("timestamp")) / 1e6


from convgraph.session import pickle_by_value  # noqa: E402

pickle_by_value(__name__)
