"""Moving usage records between devices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.logs import computed
from ..schema import COST_COLUMNS, TOKEN_COLUMNS, TRANSFER_VERSION, USAGE_SCHEMA, conform
from ..session import staged
from ..sources.lines import read_lines
from .merge import new_rows
from .ordered import CHUNK_ROWS, running


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


_TEXT_MONEY = (*COST_COLUMNS, "cost_multiplier")


def _wire_type(field: T.StructField) -> T.DataType:
    if field.name in _TEXT_MONEY:
        return T.StringType()
    return T.LongType() if isinstance(field.dataType, (T.IntegerType, T.BooleanType)) else field.dataType


# Records travel in camel case, with money as text and flags as 0 or 1.
RECORD_SCHEMA = T.StructType([T.StructField(_camel(f.name), _wire_type(f)) for f in USAGE_SCHEMA])

DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("schemaVersion", T.LongType()),
        T.StructField("exportedAt", T.LongType()),
        T.StructField("sourceDevice", T.StructType([T.StructField(c, T.StringType()) for c in ("id", "name")])),
        T.StructField("records", T.ArrayType(RECORD_SCHEMA)),
    ]
)


def to_records(usage: DataFrame) -> DataFrame:
    return usage.select(*[F.col(f.name).cast(_wire_type(f)).alias(_camel(f.name)) for f in USAGE_SCHEMA])


def from_records(records: DataFrame, *extra: str) -> DataFrame:
    def typed(f: T.StructField) -> Column:
        wire = F.col(_camel(f.name))
        if isinstance(f.dataType, T.BooleanType):
            wire = wire.cast("int")
        return wire.cast(f.dataType).alias(f.name)

    return records.select(*extra, *[typed(f) for f in USAGE_SCHEMA])


def export_usage(usage: DataFrame, path: str, device_id: str, device_name: str, exported_at: int) -> DataFrame:
    """Write the records in time order as JSON lines with a manifest; returns the manifest.

    The order is a range partitioning, so files and their rows follow it without
    one task sorting everything.
    """
    spark = usage.sparkSession
    ordered = usage.orderBy("created_at", "request_id")
    to_records(ordered).write.json(f"{path}/records")
    manifest = spark.read.schema(RECORD_SCHEMA).json(f"{path}/records").agg(
        F.lit(TRANSFER_VERSION).cast("bigint").alias("schemaVersion"),
        F.lit(exported_at).cast("bigint").alias("exportedAt"),
        F.struct(F.lit(device_id).alias("id"), F.lit(device_name).alias("name")).alias("sourceDevice"),
        F.count("*").alias("recordCount"),
    )
    manifest.write.json(f"{path}/manifest")
    return spark.read.schema(manifest.schema).json(f"{path}/manifest")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Records of an exported dataset; blank devices become the exporting one."""
    manifest = spark.read.schema("schemaVersion bigint, sourceDevice struct<id:string,name:string>").json(
        f"{path}/manifest"
    )
    head = manifest.first()  # the manifest is one row
    _check_version(head["schemaVersion"])
    records = spark.read.schema(RECORD_SCHEMA).json(f"{path}/records")
    return fill_device(from_records(records), F.lit(head["sourceDevice"]["id"]), F.lit(head["sourceDevice"]["name"]))


def read_documents(documents: DataFrame, max_records: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Records of transfers in single-document form, from (value).

    Documents above ``max_records`` or ``max_bytes`` are refused; there is no limit unless one is given.
    """
    # making and parsing the documents is the work: done once, checks and rows read the table
    sized = documents.select(F.octet_length("value").alias("_bytes"), F.from_json("value", DOCUMENT_SCHEMA).alias("d"))
    parsed = staged(
        sized.select(
            "_bytes",
            F.col("d.schemaVersion").alias("_version"),
            F.size("d.records").alias("_records"),
            F.col("d.sourceDevice").alias("_from"),
            F.posexplode_outer("d.records").alias("_at", "r"),
        ),
        "transfer-records",
    )
    worst = parsed.agg(
        F.count_if(F.col("_version").isNull() | (F.col("_version") != TRANSFER_VERSION)).alias("version"),
        F.max("_records").alias("records"),
        F.max("_bytes").alias("bytes"),
    ).first()
    if worst["version"]:
        raise ValueError("unsupported transfer version")
    if max_bytes is not None and (worst["bytes"] or 0) > max_bytes:
        raise ValueError("transfer document too large")
    if max_records is not None and (worst["records"] or 0) > max_records:
        raise ValueError("too many records in transfer")
    rows = parsed.filter("_at is not null")  # of a document without records there is one row, with no place
    usage = from_records(rows.select("_from", "r.*"), "_from")
    return fill_device(usage, F.col("_from.id"), F.col("_from.name")).drop("_from")


# Fixed pattern: how the array of records opens, up to its first record.
_OPENS = r'"records"\s*:\s*\[\s*(?=\{)'


def read_large_documents(spark: SparkSession, paths: str | list[str], max_records: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """As ``read_documents``, from files whose one document may be of any size: many tasks parse it.

    A file is read in pieces that end at a closing brace, which are splittable like lines. The
    quotes of all pieces before one tell whether it starts inside a string, the brackets outside
    strings how deep it starts, both as running sums over a narrow table of counts; so a piece
    knows whether it is part of a record. Counts are made for both cases, inside and outside, so the
    sums move no text. Nor do pieces that are a whole record; only those of other records and
    around the records are looked up and put together. No task holds more of a document than
    a record, or what is around the records.
    """
    raw = read_lines(spark, paths, line_sep="}").select("file_path", "file_size", "line_no", "value")
    sizes = staged(
        raw.groupBy("file_path").agg(
            F.max("line_no").alias("_last"), (F.sum(F.octet_length("value") + 1) > F.first("file_size")).alias("_open")
        ),
        "document-sizes",
    )
    # the last piece of a file has a brace unless the file goes on behind its last one
    is_open = F.col("_open") & (F.col("line_no") == F.col("_last"))
    pieces = raw.join(sizes, "file_path").select(
        "file_path", "line_no", F.when(is_open, F.col("value")).otherwise(F.concat("value", F.lit("}"))).alias("value")
    )

    def number(text: Column, mark: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(mark)))

    def counts(marks: str) -> Column:
        c = F.col(marks)
        braces, brackets = number(c, "{") - number(c, "}"), number(c, "[") - number(c, "]")
        return F.struct(braces.alias("braces"), brackets.alias("brackets"), F.substring(c, 1, 1).alias("starts"))

    plain = F.regexp_replace("value", r'\\[\\"]', "")  # without escaped quotes
    marks = lambda text: F.regexp_replace(F.regexp_replace(text, r'"[^"]*("|$)', ""), r"[^{}\[\]]", "")
    # up to an array of records, if one may open here
    ahead = F.regexp_replace(F.regexp_replace(F.regexp_extract("value", rf"^([\s\S]*?){_OPENS}", 1), r'\\[\\"]', ""), r'"[^"]*"', "")
    may_open = F.col("value").rlike(_OPENS)
    own = computed(pieces, ["file_path", "line_no"], {"_plain": plain, "_may_open": may_open, "_ahead": F.when(may_open, ahead).otherwise("")})
    both = {"_outside": marks(F.col("_plain")), "_inside": marks(F.regexp_replace("_plain", r'^[^"]*"?', ""))}
    own = computed(own, own.columns, both)
    counted = staged(
        own.select(
            "file_path",
            "line_no",
            number(F.col("_plain"), '"').alias("_own"),
            counts("_outside").alias("_outside"),
            counts("_inside").alias("_inside"),
            "_may_open",
            number(F.col("_ahead"), "{").alias("_ahead_b"),
            (number(F.col("_ahead"), "[") - number(F.col("_ahead"), "]")).alias("_ahead_k"),
        ),
        "document-counts",
    )
    quoted = running(counted, ["file_path"], "line_no", total={"_quotes": F.col("_own")}, chunk_rows=chunk_rows)
    inside = (F.col("_quotes") - F.col("_own")) % 2 == 1
    marked = staged(
        quoted.select(
            "file_path",
            "line_no",
            F.when(inside, F.col("_inside")).otherwise(F.col("_outside")).alias("_m"),
            (~inside & F.col("_may_open")).alias("_may_open"),
            "_ahead_b",
            "_ahead_k",
        ),
        "document-marks",
    )
    deep = running(
        marked, ["file_path"], "line_no", total={"_braces": F.col("_m.braces"), "_brackets": F.col("_m.brackets")}, chunk_rows=chunk_rows
    )
    placed = deep.withColumns({"_b": F.col("_braces") - F.col("_m.braces"), "_k": F.col("_brackets") - F.col("_m.brackets")})

    # an array on the first level: of records, or another
    on_first_level = (F.col("_b") + F.col("_ahead_b") == 1) & (F.col("_k") + F.col("_ahead_k") == 0)
    first = F.col("_may_open") & on_first_level
    placed = staged(
        placed.select("file_path", "line_no", "_braces", "_brackets", "_b", "_k", F.col("_m.starts").alias("_begins"), first.alias("_first")),
        "document-depths",
    )
    closes = (F.col("_k") == 0) | ((F.col("_b") == 1) & (F.col("_begins") == "]"))
    opens = F.when(F.col("_first"), F.lit(True)).when(closes & (F.col("_brackets") > 0), F.lit(False))
    known = running(placed, ["file_path"], "line_no", last_before={"_of_records": opens}, chunk_rows=chunk_rows)
    within = (F.col("_k") >= 1) & F.coalesce("_of_records", F.lit(False))
    next_ = within & (F.col("_b") == 1) & (F.col("_begins") == "{")
    known = staged(
        known.select(
            "file_path",
            "line_no",
            "_first",
            (F.col("_first") | next_).alias("_starts"),
            (F.col("_first") | next_ | (within & (F.col("_b") >= 2))).alias("_part"),
            (next_ & ~F.col("_first") & (F.col("_braces") == 1)).alias("_whole"),
        ),
        "document-known",
    )
    numbered = running(known, ["file_path"], "line_no", count={"_record": F.col("_starts")}, chunk_rows=chunk_rows)
    others = staged(numbered.filter(~F.col("_whole")).drop("_whole"), "document-others")
    place = ["file_path", "line_no"]
    strip = F.regexp_replace("value", r"^[\s,]+", "")
    cut = F.when(F.col("_first"), F.regexp_replace("value", rf"^[\s\S]*?{_OPENS}", "")).when(F.col("_starts"), strip)
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", c.alias("t")))), lambda x: x["t"]), "")
    kept = pieces.join(others, place).select(*place, "value", "_first", "_part", "_record", cut.alias("_cut"))
    kept = staged(kept, "document-pieces")
    joined = kept.filter("_part").groupBy("file_path", "_record").agg(text(F.coalesce("_cut", "value")).alias("value"))
    whole = pieces.join(others.select(*place), place, "left_anti").select("file_path", strip.alias("value"))
    records = whole.unionByName(joined.drop("_record"))
    head = F.when(F.col("_first"), F.regexp_extract("value", rf"^([\s\S]*?{_OPENS})", 1)).otherwise(F.col("value"))
    heads = kept.filter(F.col("_first") | ~F.col("_part")).groupBy("file_path").agg(text(head).alias("value"))
    heads = staged(heads.select("file_path", F.from_json("value", DOCUMENT_SCHEMA).alias("d")).select("file_path", "d.schemaVersion", "d.sourceDevice"), "document-heads")
    if not heads.filter(F.col("schemaVersion").isNull() | (F.col("schemaVersion") != TRANSFER_VERSION)).isEmpty():
        raise ValueError("unsupported transfer version")
    if max_records is not None and not records.groupBy("file_path").count().filter(F.col("count") > max_records).isEmpty():
        raise ValueError("too many records in transfer")
    rows = records.select("file_path", F.from_json("value", RECORD_SCHEMA).alias("r")).join(heads, "file_path")
    usage = from_records(rows.select(F.col("sourceDevice").alias("_from"), "r.*"), "_from")
    return fill_device(usage, F.col("_from.id"), F.col("_from.name")).drop("_from")


def _check_version(version: int) -> None:
    if version != TRANSFER_VERSION:
        raise ValueError(f"unsupported transfer version: {version}")


def fill_device(usage: DataFrame, device_id: Column, device_name: Column) -> DataFrame:
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return usage.withColumns(
        {
            "device_id": F.when(blank("device_id"), device_id).otherwise(F.col("device_id")),
            "device_name": F.when(blank("device_name"), device_name).otherwise(F.col("device_name")),
        }
    )


def is_valid_record() -> Column:
    named = [F.trim(F.coalesce(F.col(c), F.lit(""))) != "" for c in ("request_id", "provider_id", "app_type", "model")]
    counted = [F.coalesce(F.col(c), F.lit(0)) >= 0 for c in TOKEN_COLUMNS]
    ok = F.coalesce(F.col("created_at") > 0, F.lit(False))
    for check in (*named, *counted):
        ok = ok & check
    return ok


def import_usage(records: DataFrame, fact: DataFrame) -> DataFrame:
    """Rows to append; one invalid record rejects the whole import."""
    bad = records.agg(F.count_if(~is_valid_record()).alias("n")).first()["n"]
    if bad:
        raise ValueError(f"{bad} invalid records in import")
    return new_rows(conform(records), fact)


def import_summary(records: DataFrame, fact: DataFrame) -> DataFrame:
    """(imported, skipped, device_count) the import would have."""
    known = fact.select("request_id", F.lit(True).alias("_known"))
    per_id = records.groupBy("request_id", "device_id").agg(F.count("*").alias("n"))
    flagged = per_id.join(known, "request_id", "left")
    ids = flagged.groupBy("request_id").agg(F.sum("n").alias("n"), F.max("_known").alias("known"))
    sizes = ids.agg(
        F.count_if(F.col("known").isNull()).alias("imported"),
        (F.sum("n") - F.count_if(F.col("known").isNull())).alias("skipped"),
    )
    devices = records.agg(F.countDistinct("device_id").alias("device_count"))
    both = sizes.unionByName(devices, allowMissingColumns=True)
    return both.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("imported", "skipped", "device_count")])
