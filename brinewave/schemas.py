"""Explicit schemas of the tables the jobs exchange.

Times are kept as BIGINT microseconds (``*_us``) wherever arithmetic is done on
them, and as TIMESTAMP_NTZ at the edges.
"""

from pyspark.sql import types as T

# name, parser pattern: fixed values of the file and annotation formats
STAMP = "yyyyMMdd_HHmmss"

ANNOTATION_CSV_TEST = T.StructType(
    [
        T.StructField("station", T.StringType()),
        T.StructField("class", T.StringType()),
        T.StructField("stamp", T.StringType()),
        T.StructField("n_annotators", T.IntegerType()),
    ]
)

ANNOTATION_CSV_TRAIN = T.StructType(
    [
        T.StructField("station", T.StringType()),
        T.StructField("class", T.StringType()),
        T.StructField("stamp", T.StringType()),
        T.StructField("stamp_end", T.StringType()),
    ]
)

PICK = "struct<offset_s:double,n_annotators:int,copies:bigint>"

# samples are doubles, so that float recordings keep their values; halo holds the
# file's samples that follow the chunk, so that frames can reach over its end
CHUNKS = (
    "station string, file_start_us bigint, file_samples bigint, first_sample bigint, "
    "chunk_us bigint, fs int, bits int, samples array<double>, halo array<double>"
)

DATASET_CONFIG = T.MapType(
    T.StringType(),
    T.StructType(
        [
            T.StructField("root_dir", T.StringType()),
            T.StructField(
                "stations",
                T.MapType(
                    T.StringType(),
                    T.StructType(
                        [
                            T.StructField("date_start", T.StringType()),
                            T.StructField("date_end", T.StringType()),
                        ]
                    ),
                ),
            ),
        ]
    ),
)

EVENT_CONFIG = T.MapType(
    T.StringType(),
    T.StructType(
        [
            T.StructField("dataset", T.StringType()),
            T.StructField("station", T.StringType()),
            T.StructField("segment_duration_s", T.StringType()),
            T.StructField("segment_center", T.StringType()),
            T.StructField("arrow_offset", T.StringType()),
        ]
    ),
)
