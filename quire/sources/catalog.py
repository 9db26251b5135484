"""Catalogues of files: scanning, naming, finding copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators.ranks import running

#: Folders that a scan passes over (fixed values).
SKIPPED = ("node_modules", "__pycache__", "venv", ".git", "static", "annotations")
MAX_UPLOAD = 128 << 20
UNITS = ("B", "KB", "MB", "GB")
#: A name that ends in a number as given out for a name in use.
NUMBERED = r"^(.*)-([1-9][0-9]{0,17})$"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), r"[/\\]"), -1)


def doc_key(name: Column | str, size: Column | str) -> Column:
    """Sixteen hex digits of the SHA-1 of name and size."""
    return F.substring(F.sha1(F.concat_ws("|", _col(name), _col(size).cast("string"))), 1, 16)


def human_size(size: Column | str) -> Column:
    """512 B, 2.0 KB and so on up to GB."""
    n = _col(size)
    out = F.format_string("%.1f GB", F.bround(n / 1024.0**3, 1))
    for i in (2, 1):
        out = F.when(n / 1024.0**i < 1024, F.format_string(f"%.1f {UNITS[i]}", F.bround(n / 1024.0**i, 1))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).otherwise(out)


def scan_catalog(spark: SparkSession, paths: list[str], suffix: str = "pdf", cap: int | None = None) -> DataFrame:
    """Files below the paths, newest first: path, name, folder, size, size_text, mtime and doc_id; contents are not read.

    Dot folders and SKIPPED ones are passed over and equal paths count once. With a cap, the
    newest stay and `truncated` says whether there were more.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.[{suffix[0].lower()}{suffix[0].upper()}]*").load(paths)
    return listed(files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")), suffix, cap)


def listed(files: DataFrame, suffix: str = "pdf", cap: int | None = None) -> DataFrame:
    """The catalogue of rows with path, size and mtime."""
    parts = F.split("path", "/")
    hidden = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.startswith(".") | F.lower(p).isin(*SKIPPED))
    kept = files.where(F.lower("path").endswith(f".{suffix}") & ~hidden).dropDuplicates(["path"])
    name = base_name("path")
    out = kept.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("name"), F.regexp_replace("path", r"/[^/]*$", "").alias("folder"),
                      "size", human_size("size").alias("size_text"), "mtime", doc_key(name, "size").alias("doc_id"))
    newest = [F.col("mtime").desc(), F.col("path")]
    if cap is None:
        return out.orderBy(*newest)
    return out.orderBy(*newest).limit(cap + 1).withColumn("at", F.row_number().over(Window.orderBy(*newest))).withColumn(
        "truncated", F.max("at").over(Window.partitionBy()) > cap).where(F.col("at") <= cap).drop("at")


def catalog_search(catalog: DataFrame, words: str, cap: int | None = None) -> DataFrame:
    """Rows whose name or path holds the trimmed words, case ignored; with a cap, the first by path."""
    low = F.lit(words.strip().lower())
    found = catalog.where(F.lower("name").contains(low) | F.lower("path").contains(low))
    return found if cap is None else found.orderBy("path").limit(cap)


def fingerprint_collisions(catalog: DataFrame) -> DataFrame:
    """doc_ids (name and size) under which different contents stand, with their number."""
    hashed = catalog.select("doc_id", F.sha1(F.col("content").cast("binary")).alias("sha"))
    return hashed.groupBy("doc_id").agg(F.count_distinct("sha").alias("contents")).where("contents > 1")


def dedupe_uploads(uploads: DataFrame, magic: bytes = b"%PDF-", most: int = MAX_UPLOAD) -> DataFrame:
    """Uploads with the right first bytes and at most `most` bytes, one per content: that with the least path."""
    content = F.col("content").cast("binary")
    valid = uploads.where((F.octet_length(content) <= most) & (F.substring(content, 1, len(magic)) == F.lit(magic)))
    keyed = valid.withColumn("sha", F.sha1(content))
    return keyed.join(keyed.groupBy("sha").agg(F.min("path").alias("path")), ["sha", "path"])


def clean_name(name: Column | str, most: int = 60, default: str = "document") -> Column:
    bare = F.substring(F.trim(F.regexp_replace(_col(name), r'[\\/:*?"<>|]', "")), 1, most)
    return F.when(F.length(bare) > 0, bare).otherwise(F.lit(default))


def unique_names(rows: DataFrame, name: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """rows with out_name: the cleaned name for the first row that has it, unless it is taken (column name); then name-2, name-3 and so on, as far as no row has that name and it is not taken.

    Names are found by counting: the k-th further row of a name gets the k-th free number,
    which is k + 1 and one more for each number in use that has fewer than k free ones below.
    """
    named = rows.withColumn("__stem", clean_name(name))
    used = rows.sparkSession.createDataFrame([], "__used string") if taken is None else taken.select(clean_name(name).alias("__used")).distinct()
    numbered = running(named, ["__stem"], [order], {"__k": F.lit(1)}).join(used, F.col("__stem") == F.col("__used"), "left")
    numbered = numbered.withColumn("__k", F.col("__k") + F.col("__used").isNotNull().cast("int")).drop("__used")
    names = named.select("__stem").unionByName(used.withColumnRenamed("__used", "__stem")).distinct()
    numbers = names.select(F.regexp_extract("__stem", NUMBERED, 1).alias("__stem"), F.regexp_extract("__stem", NUMBERED, 2).alias("__n")).where("__n <> ''")
    barred = running(numbers.select("__stem", F.col("__n").cast("long").alias("__n")).where("__n >= 2"), ["__stem"], ["__n"], {"__i": F.lit(1)})
    barred = barred.select("__stem", (F.col("__n") - 2 - F.col("__i")).alias("__k"), F.lit(1).alias("__bar"))
    first, more = numbered.where("__k = 0"), numbered.where("__k > 0").withColumn("__bar", F.lit(0))
    both = running(more.unionByName(barred, allowMissingColumns=True), ["__stem"], ["__k", "__bar"], {"__skip": F.col("__bar")}).where("__bar = 0")
    further = both.withColumn("out_name", F.concat("__stem", F.lit("-"), (F.col("__k") + 1 + F.col("__skip")).cast("string")))
    return first.withColumn("out_name", F.col("__stem")).select(*rows.columns, "out_name").unionByName(further.select(*rows.columns, "out_name"))


def save_latest(rows: DataFrame, key: str = "doc_id", updated: str = "updated") -> DataFrame:
    """The last written row of each key; equal times go to the greatest row."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(updated, F.hash(*others))).alias("x")).select(key, "x.*")


def write_new(df: DataFrame, path: str) -> None:
    """Write to a place that does not exist yet; nothing is ever written over, and no change is an error."""
    if df.isEmpty():
        raise ValueError("nothing changed")
    df.write.mode("errorifexists").parquet(path)


def outcome(before: Column | str, after: Column | str) -> Column:
    """`changed` or `unchanged`: whether a run would write something new for a row; nulls are equal."""
    before, after = (F.col(c) if isinstance(c, str) else c for c in (before, after))
    return F.when(before.eqNullSafe(after), "unchanged").otherwise("changed")


ANNOTATIONS = "doc_id string, items array<struct<id:string,page:int,type:string,rects:array<array<double>>,color:string,note:string,text:string,created:double>>, updated double"


def parse_json(rows: DataFrame, text: str = "value", schema: str = ANNOTATIONS) -> DataFrame:
    """rows with the keys of the JSON object in text: a missing list is empty, a missing time 0; what cannot be read stays in _corrupt_record (null for null)."""
    held = F.from_json(text, schema + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    read = rows.withColumn("__json", held).select(*[c for c in rows.columns if c != text], "__json.*")
    return read.withColumns({"items": F.coalesce("items", F.array().cast(read.schema["items"].dataType)), "updated": F.coalesce("updated", F.lit(0.0))})


def load_json(spark: SparkSession, path: str, schema: str = ANNOTATIONS) -> DataFrame:
    """One JSON object per file, as by parse_json."""
    return parse_json(spark.read.text(path, wholetext=True), "value", schema)


def expire(rows: DataFrame, now: Column, hours: float, stamp: str = "mtime") -> DataFrame:
    """Rows not older than the given hours."""
    return rows.where(F.col(stamp) >= now - F.make_interval(hours=F.lit(int(hours))))
