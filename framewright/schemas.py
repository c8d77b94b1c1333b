"""Schemas of all tables; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.operators.scoring import FEATURES

FRAME = "path string, timestamp timestamp_ntz, exposure double, f_number double, iso double"
JOBS = (
    "job_id long, bracket_files string, status string, output_path string, created_at string, settings string, "
    "error string, wall_seconds double, peak_memory_mb double"
)
RUNS = "run_id long, job_id long, old_status string, new_status string, timestamp string"
BENCHMARKS = (
    "bench_id long, bracket_files string, mode string, tile_size int, overlap int, tiles int, width int, height int, "
    "baseline_memory_mb double, peak_memory_mb double, peak_commit_mb double, wall_seconds double, error string, timestamp string"
)
ADJUSTMENTS = "id long, scene_type string, param string, auto_value double, user_value double, delta double, timestamp string"
CLASSIFICATIONS = (
    "id long, timestamp string, source string, call string, label string, confidence double, features string, scores string, "
    "thresholds string, true_label string"
)
SYNC_RUNS = "id long, timestamp string, group_name string, n_images int, target string, strength double, thresholds string"
SYNC_IMAGES = (
    "id long, run_id long, source string, status string, stats string, needed_dl double, needed_dab double, applied_dl double, "
    "applied_da double, applied_db double, reason string"
)
MANIFEST = "camera string, image string, mask string, hour int, night int"
SPLITS = (
    "seed int, size int, night_threshold double, day_hours array<int>, night_filtered_splits array<string>, max_per_camera int, "
    "missing array<string>, test array<string>, val array<string>, train array<string>"
)
TRAINING_LOG = (
    "epoch int, train_loss double, val struct<loss:double,miou:double,sky_iou:double,bg_iou:double,images:int>, seconds double, "
    "best_miou double, train_images int"
)
IMAGE = "h int, w int, c int, dtype string, data binary"
SCENE = ", ".join(f"{f} double" for f in FEATURES)
CATALOG = "name string, url string, md5 string, size long"

STATUSES = ("pending", "running", "complete", "failed")
MODES = ("whole", "tiled")


def migrated(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with every column of the schema in order; columns it lacks are NULL."""
    wanted = T._parse_datatype_string(schema)
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]
    )


def violations(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows that a check constraint on the column would refuse."""
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(*allowed))
