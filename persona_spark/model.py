"""Schemas of the tables the operators exchange."""

from pyspark.sql import types as T

# One note page as it comes from a dump. The values of `properties` and of each block stay
# raw JSON: their shape depends on the data and is parsed on demand.
PAGE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("object", T.StringType()),
        T.StructField("created_time", T.StringType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("_content", T.StringType()),
        T.StructField("_blocks", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    ]
)

# One saved response of a paged listing. `dump_id` numbers the fetches in time order and
# `response_no` the responses of one fetch from 0.
RESPONSE = T.StructType(
    [
        T.StructField("dump_id", T.LongType()),
        T.StructField("persona_id", T.LongType()),
        T.StructField("response_no", T.LongType()),
        T.StructField("results", T.ArrayType(PAGE)),
        T.StructField("has_more", T.BooleanType()),
        T.StructField("next_cursor", T.StringType()),
    ]
)

#: An ingest position, see `sources.dumps`.
POSITION = T.DecimalType(38, 9)

MEMORY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("persona_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("alt_content", T.StringType()),
        T.StructField("created_time", T.StringType()),
        T.StructField("ingest_pos", POSITION),
    ]
)

TITLE_PROPERTY = "type STRING, title ARRAY<STRUCT<plain_text STRING>>"
BLOCK_PAYLOAD = "rich_text ARRAY<STRUCT<plain_text STRING>>"
CONVERSATION = "array<struct<role:string,content:string>>"
