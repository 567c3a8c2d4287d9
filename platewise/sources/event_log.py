"""The drawing-event log: one wide, fixed schema, stored so that ordered state needs neither shuffle nor sort.

The log is bucketed by job and each bucket is sorted by (job_id, page_num, op_idx, seq) in one file, so that a window over a job in
drawing order reads the table as it lies. It is written once for all rule families that carry graphics state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_BOX, _MATRIX = "struct<x0:double,y0:double,x1:double,y1:double>", "struct<a:double,b:double,c:double,d:double,e:double,f:double>"
#: Null means that an event does not have the field, or leaves the state unchanged.
SCHEMA = f"""job_id long, page_num int, op_idx long, kind string, operator string, bbox {_BOX}, ctm {_MATRIX}, color_space string, color_values array<double>, stroking boolean,
  fill boolean, stroke boolean, even_odd boolean, stroke_color_space string, stroke_color_values array<double>, line_width double, line_cap int, line_join int, dash array<double>, point_count int,
  overprint_stroke boolean, overprint_fill boolean, overprint_mode int, stroke_alpha double, fill_alpha double, blend_mode string, image_name string, pixel_width int, pixel_height int, bits int, filters array<string>,
  soft_mask boolean, inline_image boolean, opi boolean, alternates boolean, font_name string, font_size double, text_matrix {_MATRIX}, rendering_mode int, rendering_intent string, text string,
  form_name string, nesting_depth int, halftone boolean, transfer_function boolean, bg_ucr boolean, seq long"""
ORDER = ["job_id", "page_num", "op_idx"]
#: Drawing order: events that share a number stand as they were told, by ``seq``.
DRAWN = [*ORDER, "seq"]
#: The kinds of events.
KINDS = ("image", "text", "colour", "opacity", "overprint", "form", "path", "line_style", "prepress", "clip")


def fields() -> StructType:
    return StructType.fromDDL(SCHEMA)


def raw_events(spark: SparkSession, path: str) -> DataFrame:
    """Extracted events, one JSON object a line, in the fixed schema: fields that are missing are null, unknown ones are left out."""
    return spark.read.schema(SCHEMA).json(path)


def as_events(rows: DataFrame) -> DataFrame:
    """``rows`` in the fixed schema; columns that it does not have are null, others are left out."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields()])


def write_event_log(events: DataFrame, name: str, path: str | None = None, buckets: int = 200) -> None:
    """Store events as the table ``name``: a file for each bucket of jobs, in drawing order. ``events`` may have any subset of the schema."""
    rows = as_events(events).where(F.col("job_id").isNotNull()).repartition(buckets, "job_id")
    writer = rows.write.bucketBy(buckets, "job_id").sortBy(*DRAWN).format("parquet").mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def event_log(spark: SparkSession, name: str) -> DataFrame:
    """The table as it lies. That a bucket's one file is sorted is told to the planner by a setting of the session."""
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    return spark.table(name)


def with_state(events: DataFrame) -> DataFrame:
    """Events with the graphics state at each: overprint, its mode and the least alpha so far in the job, current colours.

    A path's own colour goes before the current one.
    """
    from platewise.operators.series import carried

    rows = events.withColumns(
        {
            "fill_space": F.when((F.col("kind") == "colour") & ~F.coalesce("stroking", F.lit(False)), F.col("color_space")),
            "stroke_space": F.when((F.col("kind") == "colour") & F.col("stroking"), F.col("color_space")),
        }
    )
    rows = carried(rows, DRAWN[:1], DRAWN[1:], ["overprint_fill", "overprint_stroke", "overprint_mode", "fill_space", "stroke_space"])
    return rows.withColumns({"fill_space": F.coalesce(F.when(F.col("kind") == "path", F.col("color_space")), "fill_space"), "stroke_space": F.coalesce("stroke_color_space", "stroke_space")})
