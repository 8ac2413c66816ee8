"""Table schemas, label lists and constants."""

from __future__ import annotations

from pyspark.sql import types as T

ARTICLES = T.StructType(
    [
        T.StructField("url", T.StringType(), False),
        T.StructField("coord", T.StringType(), True),
    ]
)

REVISIONS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("original_revid", T.LongType()),
        T.StructField("article_url", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("diff_before", T.StringType()),
        T.StructField("diff_after", T.StringType()),
        T.StructField("change_type", T.StringType()),
        T.StructField("change_desc", T.StringType()),
        T.StructField("bias_score_before", T.DoubleType()),
        T.StructField("bias_score_after", T.DoubleType()),
        T.StructField("bias_delta", T.DoubleType()),
        T.StructField("bias_label_before", T.StringType()),
        T.StructField("bias_label_after", T.StringType()),
        T.StructField("ai_topic", T.StringType()),
        T.StructField("ai_political_stance", T.StringType()),
        T.StructField("is_ip", T.IntegerType()),
        T.StructField("manual_bias", T.StringType()),
        T.StructField("manual_topic", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)

LABEL_EVENTS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("stance", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("event_seq", T.LongType()),
        T.StructField("kind", T.StringType()),
    ]
)

_REVISION_JSON = T.StructType(
    [
        T.StructField("revid", T.LongType()),
        T.StructField("user", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField(
            "slots",
            T.StructType([T.StructField("main", T.StructType([T.StructField("*", T.StringType())]))]),
        ),
        T.StructField("*", T.StringType()),
    ]
)

HISTORY_PAGE = T.StructType(
    [
        T.StructField(
            "query",
            T.StructType(
                [
                    T.StructField(
                        "pages",
                        T.MapType(
                            T.StringType(),
                            T.StructType(
                                [
                                    T.StructField("title", T.StringType()),
                                    T.StructField("revisions", T.ArrayType(_REVISION_JSON)),
                                ]
                            ),
                        ),
                    )
                ]
            ),
        ),
        T.StructField("continue", T.MapType(T.StringType(), T.StringType())),
    ]
)

DISCOVERY_RESULT = T.StructType(
    [
        T.StructField(
            "results",
            T.StructType(
                [
                    T.StructField(
                        "bindings",
                        T.ArrayType(
                            T.MapType(
                                T.StringType(), T.StructType([T.StructField("value", T.StringType())])
                            )
                        ),
                    )
                ]
            ),
        )
    ]
)

# The label lists reviewers and classifiers choose from, in display order.
TOPICS = (
    "Sovereignty",
    "International Relations",
    "Military",
    "Diplomacy",
    "Politics",
    "History",
    "Economy",
    "Culture",
    "Geography",
    "Technology",
    "Other",
)
STANCES = ("Neutral", "Pro-China", "Pro-Taiwan", "Anti-China", "Anti-Taiwan", "None")

# Literals and thresholds that results depend on.
SKIPPED = "SKIPPED"
NOT_AVAILABLE = "N/A"
NEUTRAL = "Neutral"
DELTA_GATE = 0.1
SCORE_GATE = 0.3
OUTLIER_Z = 1.5
QUEUE_SIZE = 100
DESCRIPTION_FACETS = 50
TOP_LABELS = 10
HISTOGRAM_BINS = ("0-.2", ".2-.4", ".4-.6", ".6-.8", ".8-1")
# Box for filling in missing coordinates, in 1/100000 degree.
FILL_LON_MIN, FILL_LAT_MIN, FILL_SPAN = 12090000, 2450000, 50000
