"""Reading logs, picks, constraints and mappings from CSV, and writing results; columns are chosen by mapping, types are explicit."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tephra.functions.columns import decode_path, encode_path, flag
from tephra.operators.series import common_grid, minmax_normalise


def read_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """All columns as strings: what is used is cast where it is used, so that no second pass guesses types."""
    return spark.read.option("header", True).csv(path)


def _number(df: DataFrame, c: str):
    v = F.expr(f"try_cast(`{c}` as double)")
    return F.when(F.isnan(v), None).otherwise(v)


def load_log(spark: SparkSession, paths: Mapping[str, str], columns: Mapping[str, str], core_id: str, depth_column: str = "SB_DEPTH_cm", normalise: bool = True, strict: bool = False) -> DataFrame:
    """(core_id, k, depth, v array<double>): the named logs of a core on one grid, each scaled to [0, 1] if asked.

    paths: log name to file; columns: log name to column. A log whose file or column is missing is left out with a warning, or raises if
    strict. Empty cells are null and don't count for the scale.
    """
    parts = []
    for name, path in paths.items():
        try:
            raw = read_csv(spark, path)
            missing = [c for c in (depth_column, columns[name]) if c not in raw.columns]
        except Exception as e:
            if strict or "PATH_NOT_FOUND" not in str(e):
                raise
            missing = [path]
        if missing:
            if strict:
                raise ValueError(f"log {name}: no {', '.join(missing)}")
            warnings.warn(f"log {name} left out: no {', '.join(missing)}", stacklevel=2)
            continue
        parts.append(raw.select(F.lit(core_id).alias("core_id"), F.lit(name).alias("log"), _number(raw, depth_column).alias("depth"), _number(raw, columns[name]).alias("v")).where("depth is not null"))
    if not parts:
        raise ValueError("no log could be read")
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    if normalise:
        both = minmax_normalise(both, "v", ["core_id", "log"])
    grid = common_grid(both.where("v is not null"), ["core_id"], "log", "depth", "v")
    order = F.array(*[F.lit(n) for n in paths])
    values = F.transform(F.array_sort(F.collect_list(F.struct(F.array_position(order, F.col("log")).alias("o"), "v"))), lambda s: s["v"])
    return grid.groupBy("core_id", "k").agg(F.first("depth").alias("depth"), values.alias("v")).withColumnRenamed("k", "idx")


def load_picks(spark: SparkSession, path: str, core_id: str, categories: int | Sequence[int] | None = None) -> DataFrame:
    """(core_id, depth, category, bed) of the wanted categories; a missing bed is ''."""
    raw = read_csv(spark, path)
    out = raw.select(F.lit(core_id).alias("core_id"), _number(raw, "picked_depths_cm").alias("depth"), F.expr("try_cast(category as int)").alias("category"), (F.coalesce("interpreted_bed", F.lit("")) if "interpreted_bed" in raw.columns else F.lit("")).alias("bed"))
    wanted = [categories] if isinstance(categories, int) else categories
    return out.where(F.col("category").isin(list(wanted))) if wanted is not None else out


def load_constraints(spark: SparkSession, path: str | Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """(core_id, depth, age, pos_err, neg_err, in_seq, source_core, bed) of dated horizons, by ascending depth, unknown depths last.

    columns maps age, pos_error, neg_error, min_depth, and optionally max_depth, in_sequence, core, interpreted_bed to the file's names. Where
    in_sequence is mapped only true rows stay. The depth is the middle of both depths, else the least one; an empty bed is 'Unknown'.
    """
    raw = read_csv(spark, path)
    has = lambda k: columns.get(k) in raw.columns
    num = lambda k: _number(raw, columns[k]) if has(k) else F.lit(None).cast("double")
    text = lambda k: F.col(f"`{columns[k]}`") if has(k) else F.lit(None).cast("string")
    depth = F.coalesce((num("min_depth") + num("max_depth")) / 2, num("min_depth"))
    in_seq = flag(text("in_sequence")) if has("in_sequence") else F.lit(True)
    bed = text("interpreted_bed")
    out = raw.select(text("core").alias("core_id"), depth.alias("depth"), num("age").alias("age"), num("pos_error").alias("pos_err"), num("neg_error").alias("neg_err"), in_seq.alias("in_seq"), text("core").alias("source_core"), F.when(F.coalesce(bed, F.lit("")) == "", "Unknown").otherwise(bed).alias("bed"))
    return out.where("in_seq").orderBy(F.col("depth").asc_nulls_last())


def combine_constraints(parts: Sequence[DataFrame]) -> DataFrame:
    """All constraints in one table, by depth, unknown depths last."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.orderBy(F.col("depth").asc_nulls_last())


def load_core_constraints(spark: SparkSession, core: str, folder: str, columns: Mapping[str, str]) -> DataFrame:
    """Constraints of every CSV file in the folder whose name contains the core's."""
    return load_constraints(spark, f"{folder}/*{core}*.csv", columns)


def load_mappings(spark: SparkSession, path: str) -> DataFrame:
    """Mappings from Parquet, or from CSV with 1-based "a,b;a,b" paths; malformed steps are left out."""
    if path.rstrip("/").endswith(".csv"):
        raw = read_csv(spark, path)
        return raw.withColumn("path", decode_path(F.col("path"), ";", 1))
    return spark.read.parquet(path)


def write_mappings(df: DataFrame, path: str, metrics_only: bool = False, fmt: str = "parquet") -> None:
    """Mappings by length and first segments, numbered from 1, metrics rounded to 6 places (perc_diag 2); CSV paths are 1-based text."""
    from tephra.plans.tables import numbered

    first = F.col("path")[0] if "path" in df.columns and dict(df.dtypes)["path"].startswith("array") else F.substring_index("path", "|", 1)
    out = numbered(df.drop("mapping_id").withColumn("__first", first), "length", "__first", "path", name="mapping_id").drop("__first").withColumn("mapping_id", F.col("mapping_id") + 1)
    places = {"norm_dtw": 6, "dtw_ratio": 6, "perc_diag": 2, "dtw_warp_eff": 6, "corr_coef": 6, "perc_age_overlap": 2}
    out = out.withColumns({c: F.round(c, n) for c, n in places.items() if c in out.columns})
    if metrics_only:
        out = out.drop("path", "combined_wp")
    if fmt == "csv":
        out = out.withColumn("path", encode_path(F.col("path"), ";", 1)) if "path" in out.columns else out
        out.drop("combined_wp").write.mode("overwrite").option("header", True).csv(path)
    else:
        out.write.mode("overwrite").parquet(path)


def write_age_model(model: DataFrame, path: str) -> None:
    names = {"depth": "picked_depths_cm", "est_age": "est_age", "pos": "est_age_poserr", "neg": "est_age_negerr"}
    model.select(*[F.col(a).alias(b) for a, b in names.items()]).orderBy("picked_depths_cm").write.mode("overwrite").option("header", True).csv(path)


def append_fits(fits: DataFrame, path: str) -> None:
    fits.write.mode("append").parquet(path)


def upsert_picks(old: DataFrame, new: DataFrame) -> DataFrame:
    """New picks (depth, category) with what the old ones at exactly their depth had besides, by category and depth."""
    more = old.drop("category")
    return new.join(more, "depth", "left").orderBy("category", "depth")


def load_depth_ages(spark: SparkSession, path: str) -> DataFrame:
    """(depth, est_age, pos, neg) from the first four columns of an age model's file, whatever their names; rows without a depth are left out."""
    raw = read_csv(spark, path)
    names = ["depth", "est_age", "pos", "neg"]
    if len(raw.columns) < 4:
        raise ValueError(f"{path} has fewer than four columns")
    return raw.select(*[_number(raw, c).alias(n) for c, n in zip(raw.columns[:4], names, strict=True)]).where("depth is not null")


def load_core(spark: SparkSession, paths: Mapping[str, str], columns: Mapping[str, str], core_id: str, picks: str | None = None, categories: int | Sequence[int] | None = None, **how) -> tuple[DataFrame, DataFrame | None]:
    """A core's logs on one grid and its picks (None without a file of them)."""
    return load_log(spark, paths, columns, core_id, **how), load_picks(spark, picks, core_id, categories) if picks else None


def clean_picks(raw: DataFrame, depth: str = "depth", category: str = "category") -> DataFrame:
    """Picks in order of category and depth; rows whose depth or category is no number are left out."""
    out = raw.withColumns({depth: F.expr(f"try_cast(`{depth}` as double)"), category: F.expr(f"try_cast(`{category}` as int)")})
    return out.where(F.col(depth).isNotNull() & ~F.isnan(depth) & F.col(category).isNotNull()).orderBy(category, depth)


def load_images(spark: SparkSession, path: str) -> DataFrame:
    """(origin, row, col, r, g, b) of the pixels of all pictures that Java's ImageIO reads (bmp, jpg, png); grey ones have r = g = b. Other
    files are left out."""
    i = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    px = i.select("origin", "width", "nChannels", "data", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("k"))
    byte = lambda c: F.conv(F.hex(F.expr(f"substring(data, k * nChannels + least({c}, nChannels - 1) + 1, 1)")), 16, 10).cast("int")
    return px.select("origin", F.floor(F.col("k") / F.col("width")).cast("int").alias("row"), (F.col("k") % F.col("width")).cast("int").alias("col"), byte(2).alias("r"), byte(1).alias("g"), byte(0).alias("b"))


def load_scans(spark: SparkSession, path: str, parse: Callable[[bytes], tuple[float, Sequence[Sequence[float]]]], force: bool = False) -> DataFrame:
    """(file, z, row, col, v) of medical images: parse gives a file's position along the scan and its rows of values.

    Readers of such formats aren't part of this library, so parse is the caller's. A file it raises on fails the job, or is left out if force.
    """

    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    z, rows = parse(data)
                except Exception:
                    if force:
                        continue
                    raise
                for k, row in enumerate(rows):
                    n = len(row)
                    yield pa.RecordBatch.from_pydict({"file": [file] * n, "z": pa.array([float(z)] * n, pa.float64()), "row": pa.array([k] * n, pa.int32()), "col": pa.array(range(n), pa.int32()), "v": pa.array([float(v) for v in row], pa.float64())})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, z double, row int, col int, v double")


def write_log(log: DataFrame, path: str, columns: Mapping[str, str], order: str = "depth") -> None:
    """A log as one CSV table in order of depth: columns maps those of log to the file's names; unknown values are empty."""
    log.select(*[F.col(a).alias(b) for a, b in columns.items()]).orderBy(columns[order]).write.mode("overwrite").option("header", True).csv(path)
