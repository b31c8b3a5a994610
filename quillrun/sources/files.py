"""Files and tables in, tables and exports out."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrun.functions.scalars import is_supported
from quillrun.operators.history import may_edit_models
from quillrun.schemas import JOB_DDL, LOG_DDL, ExtractionModel
from quillrun.sources.shared import opened, tabled, written
from quillrun.sources.workbook import sheet

ENDINGS = ("pdf", "PDF", "png", "PNG", "jpg", "JPG", "jpeg", "tif", "tiff", "bmp", "webp")
GLOB = "*.{" + ",".join(ENDINGS) + "}"
LISTED = "path string, modificationTime timestamp, length long"
BINARY = f"{LISTED}, content binary"
#: Bytes of files that a stream takes in a batch, about.
BATCH_BYTES = 1 << 30
#: Bytes and number of files that a part of a list names, about.
PART_BYTES, PART_FILES = 1 << 24, 4096


def ingest(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of the PDFs and images in a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", GLOB).option("recursiveFileLookup", "true").load(path)


def ingest_stream(spark: SparkSession, path: str, most_files: int | None = None, most_bytes: int = BATCH_BYTES) -> DataFrame:
    """The same for files as they arrive. A batch has about ``most_bytes`` at most, so small files don't make
    many batches; or ``most_files``, where that is given. Spark's driver holds the names of all files; where they
    are very many, list_new() and listed_stream() take their place."""
    limit = {"maxBytesPerTrigger": most_bytes} if most_files is None else {"maxFilesPerTrigger": most_files}
    return spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", GLOB).options(**limit).load(path)


def list_new(spark: SparkSession, path: str, listed: str) -> int:
    """Adds the PDFs and images of a folder and its subfolders whose paths a list doesn't have to the list, a
    Parquet table (path, modificationTime, length); returns how many. Tasks list the folders, level by level, so
    the driver sees no names; a folder is listed by one task. As with Spark's own reading, empty files and names
    that begin with . or _ don't count; an empty file is listed once it has content. One writer at a time; what
    a lost run has added stays and isn't added again."""
    path, endings, most = path.rstrip("/"), tuple(f".{x}" for x in ENDINGS), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def entries(batches):
        import pyarrow as pa

        system, folder = opened(path)
        stamp = pa.timestamp("us", "UTC")
        for batch in batches:
            for inner in batch["inner"].to_pylist():
                found = [x for x in system.get_file_info(fs.FileSelector(f"{folder}{inner}", allow_not_found=bool(inner))) if not x.base_name.startswith((".", "_"))]
                found = [x for x in found if x.type == fs.FileType.Directory or x.size and x.base_name.endswith(endings)]
                kinds = [x.type == fs.FileType.Directory for x in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{inner}/{x.base_name}" for x in found], pa.string()), pa.array(kinds, pa.bool_()), pa.array([x.mtime for x in found], stamp), pa.array([x.size for x in found], pa.int64())],
                    names=["inner", "is_folder", "modificationTime", "length"],
                )

    system, folder = opened(listed)
    system.create_dir(folder, recursive=True)
    level, folders, levels = spark.createDataFrame([("",)], "inner string"), 1, []
    while folders:
        levels.append(tabled(level.repartition(min(folders, most)).mapInArrow(entries, "inner string, is_folder boolean, modificationTime timestamp, length long")))
        level = levels[-1].where("is_folder").select("inner")
        folders = level.count()
    found = reduce(DataFrame.unionByName, levels).where("NOT is_folder").select(F.concat(F.lit(path), "inner").alias("path"), "modificationTime", "length")
    new = tabled(found.join(spark.read.schema(LISTED).parquet(listed).select("path"), "path", "left_anti"))
    n, size = new.agg(F.count(F.lit(1)), F.sum("length")).first()
    if n:
        new.repartition(min(n, max(ceil(n / PART_FILES), ceil(size / PART_BYTES)))).write.mode("append").parquet(listed)
    return n


def listed_stream(spark: SparkSession, path: str, listed: str, most_bytes: int = BATCH_BYTES) -> DataFrame:
    """(path, modificationTime, length, content) of the files of a folder as list_new() adds them to its list. The
    stream's source is the list, so its driver holds the names of the list's parts only, and tasks read the files,
    about ``PART_BYTES`` at a time. A batch has so many parts that their files have about ``most_bytes`` at most.
    As with Spark's own reading, a file that is gone when its turn comes is an error."""
    path = path.rstrip("/")

    def read(batches):
        import pyarrow as pa

        system, folder = opened(path)
        for batch in batches:
            names, start, held, size = batch["path"].to_pylist(), 0, [], 0
            for end, name in enumerate(names, 1):
                with system.open_input_stream(f"{folder}{name.removeprefix(path)}") as file:
                    held.append(file.read())
                size += len(held[-1])
                if size >= PART_BYTES or end == len(names):
                    part = batch.slice(start, end - start)
                    yield pa.RecordBatch.from_arrays([part["path"], part["modificationTime"], pa.array(map(len, held), pa.int64()), pa.array(held, pa.binary())], names=["path", "modificationTime", "length", "content"])
                    start, held, size = end, [], 0

    parts = spark.readStream.schema(LISTED).option("maxFilesPerTrigger", max(1, most_bytes // PART_BYTES)).parquet(listed)
    return parts.mapInArrow(read, BINARY)


def supported(files: DataFrame) -> DataFrame:
    return files.where(is_supported(F.col("path")))


def load_model(spark: SparkSession, path: str) -> ExtractionModel:
    """The model of one JSON file."""
    return ExtractionModel.from_json("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def save_model(members: DataFrame, user_id: int, model: ExtractionModel, path: str) -> None:
    """Writes a model as a new JSON file of a folder of models; administrators and model editors may."""
    if not may_edit_models(members, user_id):
        raise PermissionError(f"user {user_id} may not edit models")
    members.sparkSession.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("append").text(path)


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """(model_name, pos, key, label, type, description) of a folder of model files."""
    raw = spark.read.schema("model_name string, fields array<struct<key:string,label:string,type:string,description:string>>").json(path, multiLine=True)
    return raw.select("model_name", F.posexplode("fields").alias("pos", "f")).select("model_name", "pos", "f.*")


def save_models(models: DataFrame, path: str) -> int:
    """(model_name, fields array<struct<key, label, type, description>>) as one JSON file each, named by the
    hash of the model's name; returns how many. Saving a model again replaces its file."""
    name = F.concat(F.sha2("model_name", 256), F.lit(".json"))
    return write_files(models.select(name.alias("name"), F.to_json(F.struct("model_name", "fields")).cast("binary").alias("content")), path)


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, role) of a folder of JSON lines; rows without either are left out, repeats count once."""
    return spark.read.schema("user_id long, role string").json(path).dropna().distinct()


def read_logs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(LOG_DDL).format(fmt).load(path)


def read_jobs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(JOB_DDL).format(fmt).load(path)


def store(files: DataFrame, path: str) -> DataFrame:
    """Keeps originals as rows of a Parquet table; returns (file_url, length), without reading contents back."""
    files.select(F.col("path").alias("file_url"), "length", "content").write.mode("append").parquet(path)
    return files.sparkSession.read.parquet(path).select("file_url", "length")


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """old with rows of new in place of those with their keys, and the others of new added."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(old.columns))


def save(old: DataFrame, new: DataFrame, path: str, key: str = "id") -> DataFrame:
    """Writes the upsert as a new version to ``path``, which must not be where old is read from."""
    upserted(old, new, key).write.mode("errorifexists").parquet(path)
    return old.sparkSession.read.schema(old.schema).parquet(path)


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


def save_in_buckets(rows: DataFrame, path: str, key: str = "id", buckets: int = 64) -> None:
    """A table in as many folders as ``buckets``, dealt by key, for upsert_buckets()."""
    rows.withColumn("bucket", _bucket(key, buckets)).repartition("bucket").write.mode("errorifexists").partitionBy("bucket").parquet(path)


def upsert_buckets(new: DataFrame, path: str, schema: str, key: str = "id", buckets: int = 64) -> int:
    """Puts rows of new in place of those with their keys. Only buckets that new's keys fall in are read
    and written, each replaced by its new files when all are there; returns how many. One writer at a time."""
    spark, new = new.sparkSession, written(new.withColumn("bucket", _bucket(key, buckets)))
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # ``buckets`` numbers at most
    old = spark.read.schema(f"{schema}, bucket int").parquet(path).where(F.col("bucket").isin(touched))
    merged = written(old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(old.columns)))
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return len(touched)


def write_files(rows: DataFrame, path: str) -> int:
    """Rows (name, content binary) as files of a folder that all executors share, written where the rows
    are; returns how many. Writing a row again replaces its file. A name may hold folders, parted by /."""
    system, folder = opened(path)
    system.create_dir(folder, recursive=True)

    def run(batches):
        import pandas as pd

        system, folder = opened(path)
        made = set()
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"]):
                inner = name.rpartition("/")[0]
                if inner and inner not in made:
                    system.create_dir(f"{folder}/{inner}", recursive=True)
                    made.add(inner)
                with system.open_output_stream(f"{folder}/{name}") as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"n": [len(pdf)]})

    return rows.select("name", "content").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def ingest_once(files: DataFrame, path: str) -> DataFrame:
    """(hash, file_url, length, content) of a stream of files, each content once: its SHA-256 is its key, and
    of equal files the smallest path of the first batch counts. A batch that is repeated reads what the
    batches before it stored and writes its own part again, so a restart stores nothing twice. Spark reads
    no empty files."""
    spark = files.sparkSession
    ddl = "hash string, file_url string, length long, content binary"

    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        rows = batch.select(F.sha2("content", 256).alias("hash"), F.struct(F.col("path").alias("file_url"), "length", "content").alias("f"))
        first = rows.groupBy("hash").agg(F.min_by("f", "f.file_url").alias("f")).select("hash", "f.*")  # each file is read once
        if number:
            stored = own.read.schema(f"{ddl}, batch long").parquet(f"{path}/store").where(F.col("batch") < number)
            first = first.join(stored.select("hash"), "hash", "left_anti")
        first.write.mode("overwrite").parquet(f"{path}/store/batch={number}")

    query = files.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    try:
        return spark.read.schema(f"{ddl}, batch long").parquet(f"{path}/store").drop("batch")
    except AnalysisException:  # no file has come
        return spark.createDataFrame([], ddl)


def preview(logs: DataFrame, log_id) -> dict | None:
    """One log as a nested dictionary."""
    row = logs.where(F.col("id") == log_id).limit(1).collect()
    return row[0].asDict(recursive=True) if row else None


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def workbooks(df: DataFrame, rows_each: int = 100_000) -> DataFrame:
    """(part, content): the rows as workbooks of up to ``rows_each`` rows, made where the rows are."""
    header = df.columns

    def run(batches):
        import pandas as pd

        held: list[tuple] = []
        for pdf in batches:
            held += [tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)]
            while len(held) >= rows_each:
                yield pd.DataFrame({"content": [sheet(header, held[:rows_each])]})
                held = held[rows_each:]
        if held:
            yield pd.DataFrame({"content": [sheet(header, held)]})

    flat = df.select(*(F.col(c) if t in ("bigint", "int", "double", "string") else F.col(c).cast("string").alias(c) for c, t in df.dtypes))
    return flat.mapInPandas(run, "content binary").withColumn("part", F.monotonically_increasing_id()).select("part", "content")
