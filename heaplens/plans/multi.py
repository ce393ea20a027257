"""Comparison of many snapshots: all tables carry snapshot_id, so one pass serves any number of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heaplens.plans.golden import remapper_rows

#: Fixed value: the names of captures: prefix, date, time, and words of context if there are any.
NAME = r"^(.+?)_(\d{4}-\d{2}-\d{2})_(\d{2}-\d{2}-\d{2})(?:_(.+))?$"
#: The columns of the pivot, as group/category.
PIVOT = (
    ("Totals", "Total"), ("AllocatedMemoryDistribution", "Native"), ("AllocatedMemoryDistribution", "Managed"), ("AllocatedMemoryDistribution", "Executables & Mapped"),
    ("AllocatedMemoryDistribution", "Graphics (Estimated)"), ("AllocatedMemoryDistribution", "Untracked"), ("AllocatedMemoryDistribution", "Android Runtime"),
    ("ManagedHeapUtilization", "Virtual Machine"), ("ManagedHeapUtilization", "Objects"), ("ManagedHeapUtilization", "Empty Heap Space"),
)


def unioned(parts: dict[str, DataFrame]) -> DataFrame:
    """One table of several snapshots; columns that an older one lacks are null."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("snapshot_id", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def null_aware_sum(c: str) -> Column:
    """The sum, or null if any value is null."""
    return F.when(F.count(c) == F.count("*"), F.sum(c))


def tracked(native_objects: DataFrame, native_roots: DataFrame) -> DataFrame:
    """snapshot_id, tracked, obj_count, allocated_bytes, resident_bytes of bundles, serialized files and remappers."""
    parts = [
        (native_objects.where("native_type_name = 'AssetBundle' and not is_destroyed"), "AssetBundle", "size_bytes"),
        (native_roots.where(F.contains(F.lower(F.coalesce("area_name", F.lit(""))), F.lit("serializedfile"))), "SerializedFile", "accumulated_size_bytes"),
        (remapper_rows(native_roots), "Remapper", "accumulated_size_bytes"),
    ]
    out = None
    for df, what, size in parts:
        resident = "resident_size_bytes" if "resident_size_bytes" in df.columns else None
        df = df if resident else df.withColumn("resident_size_bytes", F.lit(None).cast("long"))
        one = df.groupBy("snapshot_id").agg(F.count("*").alias("obj_count"), F.sum(size).alias("allocated_bytes"), null_aware_sum("resident_size_bytes").alias("resident_bytes")).withColumn("tracked", F.lit(what))
        out = one if out is None else out.unionByName(one)
    return out.select("snapshot_id", "tracked", "obj_count", "allocated_bytes", "resident_bytes")


def _part(name: Column, k: int) -> Column:
    """A part of a capture's name, trimmed; null where the name has none."""
    return F.when(name.rlike(NAME), F.nullif(F.trim(F.regexp_extract(name, NAME, k)), F.lit("")))


def version_key(engine: Column, snap_format: Column) -> Column:
    """The engine's version, or the format's as `format:17`; empty where neither is known."""
    known = (F.trim(F.coalesce(engine, F.lit(""))) != "") & ~F.lower(engine).startswith("format:")
    return F.when(known, engine).when(snap_format > 0, F.concat(F.lit("format:"), snap_format.cast("string"))).otherwise("")


def version_label(version: Column) -> Column:
    """A version for readers, null if it is empty."""
    number = F.trim(F.substr(version, F.lit(8)))
    named = F.when(number != "", F.concat(F.lit("Snap format "), number))
    return F.when(F.lower(version).startswith("format:"), named).otherwise(F.nullif(F.trim(version), F.lit("")))


def session_key(name: Column, version: Column) -> Column:
    """What captures of one session share by their names: prefix, date, context and version.

    Captures without a context share their time instead.
    """
    context = F.coalesce(_part(name, 4), _part(name, 3), F.lit("_general"))
    return F.concat_ws("|", F.coalesce(_part(name, 1), name), _part(name, 2), context, F.coalesce(F.nullif(F.trim(version), F.lit("")), F.lit("unknown")))


def enriched(info: DataFrame, captures: DataFrame | None = None) -> DataFrame:
    """snapshot_id, session_guid, product_name, platform, version, captured_at of each snapshot.

    info and captures: snapshot_id, session_guid, product_name, platform, engine_version, snap_format_version,
    record_date_utc, of stores and of the capture files beside them. What a store doesn't know comes from its
    capture file, the time at last from the name. captured_at is null where no source tells it.
    """
    known = ("session_guid", "product_name", "platform", "engine_version", "snap_format_version", "record_date_utc")
    if captures is None:
        captures = info.limit(0)
    both = info.select("snapshot_id", *known).join(captures.select("snapshot_id", *[F.col(c).alias(f"file_{c}") for c in known]), "snapshot_id", "left")
    text = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    number = lambda c: F.coalesce(F.nullif(c, F.lit(0)), F.nullif(f"file_{c}", F.lit(0)), F.lit(0))
    engine = F.coalesce(F.when(~F.lower("engine_version").startswith("format:"), text("engine_version")), text("file_engine_version"), F.col("engine_version"))
    told = F.try_to_number(F.when(F.lower(engine).startswith("format:"), F.trim(F.substr(engine, F.lit(8)))), F.lit("999999999")).cast("long")
    clock = F.try_to_timestamp(F.concat_ws(" ", _part(F.col("snapshot_id"), 2), F.replace(_part(F.col("snapshot_id"), 3), F.lit("-"), F.lit(":"))))
    time = F.coalesce(F.try_to_timestamp("record_date_utc"), F.try_to_timestamp("file_record_date_utc"), clock)
    return both.select(
        "snapshot_id", number("session_guid").alias("session_guid"), *[F.coalesce(text(c), text(f"file_{c}")).alias(c) for c in ("product_name", "platform")],
        version_key(engine, F.coalesce(F.nullif(number("snap_format_version"), F.lit(0)), told)).alias("version"), time.alias("captured_at"),
    )


def sessions(info: DataFrame) -> DataFrame:
    """snapshot_id, session_no, session_key, representative, title. info: the columns of enriched().

    A non-zero GUID is the key, else the name's parts, in any case of letters. Sessions are numbered by their
    earliest capture, those with one of unknown time first.
    """
    key = F.coalesce(F.when(F.col("session_guid") != 0, F.concat(F.lit("guid:"), F.col("session_guid").cast("string"))), session_key(F.col("snapshot_id"), F.col("version")))
    keyed = info.withColumn("session_key", F.lower(key))
    first = F.struct(F.col("captured_at").isNotNull().alias("known"), "captured_at", F.lower("snapshot_id").alias("low"), "snapshot_id", "product_name", "platform", "version")
    groups = keyed.groupBy("session_key").agg(F.min(first).alias("first"))
    number = F.row_number().over(Window.orderBy(F.asc_nulls_first("first.captured_at"), "session_key"))  # one row per session
    product = F.coalesce(F.trim("first.product_name"), _part(F.col("first.snapshot_id"), 1), F.col("first.snapshot_id"))
    platform = F.nullif(platform_bucket(F.col("first.platform")), F.lit("Unknown"))
    title = F.concat_ws(" · ", F.concat(F.lit("Session "), F.col("session_no").cast("string")), product, platform, version_label(F.col("first.version")))
    numbered = groups.withColumn("session_no", number).select("session_key", "session_no", F.col("first.snapshot_id").alias("representative"), title.alias("title"))
    return keyed.join(numbered, "session_key").select("snapshot_id", "session_no", "session_key", "representative", "title")


def column_name(category: str) -> str:
    return category.lower().replace(" & ", "_").replace(" ", "_").replace("(", "").replace(")", "")


def pivoted(metrics: DataFrame) -> DataFrame:
    """One row per snapshot; committed and resident of each category, resident null where not available."""
    cols = []
    for group, category in PIVOT:
        here = (F.col("metric_group") == group) & (F.col("category") == category)
        name = column_name(category)
        cols.append(F.max(F.when(here, F.col("committed_bytes"))).alias(f"{name}_committed"))
        cols.append(F.max(F.when(here & (F.col("resident_available") == 1), F.col("resident_bytes"))).alias(f"{name}_resident"))
    return metrics.groupBy("snapshot_id").agg(*cols)


def safe_names(names: DataFrame) -> DataFrame:
    """name, file_name: letters, digits, - and _ only, and unique whatever the case."""
    clean = names.select("name", F.regexp_replace("name", r"[^A-Za-z0-9_-]+", "_").alias("clean"))
    n = F.row_number().over(Window.partitionBy(F.lower("clean")).orderBy("name"))
    return clean.withColumn("n", n).select("name", F.when(F.col("n") == 1, F.col("clean")).otherwise(F.concat_ws("_", "clean", F.col("n").cast("string"))).alias("file_name"))


def platform_bucket(platform: Column) -> Column:
    low = F.lower(F.coalesce(platform, F.lit("")))
    return F.when(low == "", "Unknown").when(low.contains("iphone") | low.contains("ios"), "iOS").when(low.contains("android"), "Android").otherwise("Other")


def capture_title(name: Column, version: Column) -> Column:
    """What a capture is called by its name: prefix, date, time unless a context tells it apart, context, version."""
    clock = F.when(_part(name, 4).isNull(), F.replace(_part(name, 3), F.lit("-"), F.lit(":")))
    words = F.filter(F.transform(F.split(_part(name, 4), "_"), F.trim), lambda w: w != "")
    word = lambda w: F.when(F.lower(w) == "ios", "iOS").when(F.lower(w) == "android", "Android").otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    context = F.coalesce(F.array_join(F.transform(words, word), " "), F.lit("General capture"))
    return F.concat_ws(" · ", F.coalesce(_part(name, 1), name), _part(name, 2), clock, context, version_label(version))
