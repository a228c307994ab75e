"""Files landed in a folder become changes of a staging table, each file once.

The stream lists new files; a micro-batch parses them, stores the rejects and the changed rows, and logs its state. The
stream's checkpoint remembers which files are done, so a stopped or failed run continues where it left off. A repeated
micro-batch writes the same folders again and reads the table as it was before, so it leaves no trace of the repetition.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from firmlake.operators.expectations import manifest_rules, split
from firmlake.plans.products import PRODUCTS, Product, accepted, load_changes, parse, rejects, shaped
from firmlake.plans.promotion import Tables
from firmlake.session import discard, settle
from firmlake.sources.archives import ENTRIES
from firmlake.sources.logs import current_batches, ingestion_log, log_batch, log_files
from firmlake.sources.tables import KeyedTable

TABLE_OF = {"company": "companies", "psc": "officers", "accounts": "financials"}
LISTING = "path string, modificationTime timestamp, length long, content binary"
SEARCH_NAME = "bulk_ingestion"
# States of a batch.
RUNNING, PAUSED, COMPLETED, WITH_ERRORS, FAILED = "running", "paused", "completed", "completed_with_errors", "failed"


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def staging_table(tables: Tables, product: Product) -> KeyedTable:
    return getattr(tables, TABLE_OF[product.name])


def load_files(
    spark: SparkSession,
    tables: Tables,
    product: Product,
    paths: DataFrame,
    batch_id: str,
    now: dt.datetime | None = None,
    files_per_step: int = 100,
) -> dict:
    """Load the archives in column ``path`` as one batch; returns its log row.

    The archives are read once, ``files_per_step`` at a time: the parsed rows are written to the shared folder, and both
    the rejects and the changes start from there. After each step the log has the files that are done, each with its
    rows, and the batch's progress. A file that cannot be opened costs that file only. What was written for the load
    alone is deleted when it ends.
    """
    started = now or _now()
    files = settle(_numbered(paths.select("path").distinct()), "files")
    state = {
        "batch_id": batch_id, "search_name": SEARCH_NAME, "status": RUNNING, "started_at": started,
        "files_total": files.count(), "files_completed": 0, "logged_at": started,
    }
    log_batch(spark, tables.ingestion_log, state)
    kept = [files]
    try:
        steps = max(1, -(-state["files_total"] // files_per_step))
        parts, failed = [], 0
        for step in range(steps):
            own = files.where(F.floor(F.col("number") / files_per_step) == step).select("path")
            part = settle(parse(product, own), f"parsed-{product.name}")
            parts.append(part)
            kept.append(part)
            if not state["files_total"]:
                continue
            # What the log says of a step is observed while its file log is written: both come from the same rows.
            seen = Observation()
            done = _file_rows(own, part, product, batch_id).observe(
                seen, F.count("*").alias("n"), F.count_if(F.col("status") == FAILED).alias("bad"), F.max("file").alias("last")
            )
            log_files(done, tables.file_log)
            counts = seen.get
            failed += counts["bad"]
            state |= {
                "files_completed": state["files_completed"] + counts["n"] - counts["bad"], "current_file": counts["last"],
                "current_file_progress": 100, "logged_at": _now(),
            }
            if step + 1 < steps:
                log_batch(spark, tables.ingestion_log, state)
        parsed = reduce(DataFrame.unionByName, parts)
        state |= _store(spark, tables, product, parsed, batch_id, started, kept)
        if failed:
            state |= {"status": WITH_ERRORS, "error_message": f"{failed} files could not be read"}
    except Exception as error:
        log_batch(
            spark, tables.ingestion_log,
            state | {"status": FAILED, "error_message": str(error), "completed_at": _now(), "logged_at": _now()},
        )
        raise
    finally:
        discard(*kept)
    state["logged_at"] = _now()
    log_batch(spark, tables.ingestion_log, state)
    return state


def _store(spark: SparkSession, tables: Tables, product: Product, parsed: DataFrame, batch_id: str, started: dt.datetime, kept: list) -> dict:
    """Write the rejects and the changes that parsed rows make; what the batch's log row says of a completed load.

    ``kept`` gets the frames that are to be discarded when the load ends.
    """
    table = staging_table(tables, product)
    bad = rejects(parsed)
    bad.withColumn("product", F.lit(product.name)).write.mode("overwrite").parquet(f"{tables.rejects}/load-{batch_id}")
    companies = tables.companies.read() if product.needs_company else None
    rows = settle(accepted(product, parsed, companies), f"accepted-{product.name}")
    kept.append(rows)
    stored = table.read(before=table.version_for(batch_id))
    changed = load_changes(product, stored, rows, batch_id, F.lit(started).cast("timestamp_ntz"))
    table.write_changes(changed.where("action in ('insert', 'update')"), batch_id)
    # Counted, not observed: where nothing can match, such as without companies, the plan drops what it would observe.
    read = parsed.agg(F.count("*").alias("rows"), F.count_if(F.col("reject").isNotNull()).alias("rejects")).first().asDict()
    written = table.read_changes(batch_id).agg(F.count("*").alias("affected"), F.count_if("change_detected").alias("updated")).first()
    counts = {
        **read,
        "inserted": written["affected"] - written["updated"],
        "updated": written["updated"],
        # Unchanged rows, duplicates within the load and orphans.
        "skipped": read["rows"] - read["rejects"] - written["affected"],
    }
    return {
        "status": COMPLETED, "companies_count": written["affected"], "metadata": json.dumps(counts), "current_file": None,
        "current_file_progress": None, "completed_at": _now(), "error_message": None,
    }


def load_listed(spark: SparkSession, tables: Tables, product: Product, listing: DataFrame, batch_id: str) -> dict:
    """Load listed entries of archives as one batch; returns its log row, which counts archives begun as files."""
    state = {"batch_id": batch_id, "search_name": SEARCH_NAME, "status": RUNNING, "started_at": _now(), "files_completed": 0, "logged_at": _now()}
    listed = settle(listing, "listing")
    kept = [listed]
    try:
        state["files_total"] = listed.agg(F.count_distinct("archive").alias("n")).first()["n"]
        log_batch(spark, tables.ingestion_log, state)
        parsed = settle(shaped(product, product.read_listed(listed)), f"parsed-{product.name}")
        kept.append(parsed)
        state |= _store(spark, tables, product, parsed, batch_id, state["started_at"], kept)
        unread = listed.where("entry is null and reject is not null").count()
        state["files_completed"] = state["files_total"] - unread
        if unread:
            state |= {"status": WITH_ERRORS, "error_message": f"{unread} files could not be read"}
    except Exception as error:
        log_batch(
            spark, tables.ingestion_log,
            state | {"status": FAILED, "error_message": str(error), "completed_at": _now(), "logged_at": _now()},
        )
        raise
    finally:
        discard(*kept)
    state["logged_at"] = _now()
    log_batch(spark, tables.ingestion_log, state)
    return state


def _numbered(paths: DataFrame) -> DataFrame:
    """The paths with a gapless ``number`` by path, from 0: a step takes so many of them, neither more nor none.

    A batch has as many files as the stream's trigger admits, a list of names; sorting it in one task is no burden.
    """
    return paths.withColumn("number", F.row_number().over(W.orderBy("path")) - 1)


def _file_rows(files: DataFrame, parsed: DataFrame, product: Product, batch_id: str) -> DataFrame:
    """One row per file: its rows that can be used, and whether it could be read at all."""
    counts = parsed.groupBy("archive").agg(
        F.count_if(F.col("reject").isNull()).alias("rows"), F.count_if(F.col("reject").isNotNull()).alias("rejects"),
        F.max(F.col("reject").isNotNull() & F.col("entry").isNull()).alias("unread"),
    )
    unread = F.coalesce("unread", F.lit(False))
    return files.join(counts, F.col("path") == F.col("archive"), "left").select(
        F.lit(batch_id).alias("batch_id"), F.lit(product.name).alias("product"), F.col("path").alias("file"),
        F.when(unread, FAILED).otherwise(COMPLETED).alias("status"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
        F.coalesce("rejects", F.lit(0)).cast("long").alias("rejects"), F.lit(_now()).cast("timestamp_ntz").alias("logged_at"),
    )


def batch_prefix(product: Product, query_id: str) -> str:
    """Start of the batch ids of a stream: no two streams share a query id, nor does a new checkpoint at an old path."""
    return f"{product.name}_{query_id.replace('-', '')}"


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The checkpoint keeps the query's id; it is there before the first micro-batch runs."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()["value"])["id"]


def _landed(spark: SparkSession, landing: str, pattern: str, files_per_batch: int) -> DataFrame:
    """Paths of landed files. Only they are selected, so the stream lists files without reading them."""
    return (
        spark.readStream.format("binaryFile")
        .schema(LISTING)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(landing)
        .select("path")
    )


def watch(
    spark: SparkSession,
    tables: Tables,
    product: Product,
    landing: str,
    checkpoint: str,
    pattern: str = "*.zip",
    files_per_batch: int = 1000,
    files_per_step: int = 100,
) -> StreamingQuery:
    """Start loading every file of the landing folder that is not loaded yet; the query ends when all are."""
    found = _landed(spark, landing, pattern, files_per_batch)

    def run(paths: DataFrame, epoch: int) -> None:
        batch_id = f"{batch_prefix(product, _query_id(spark, checkpoint))}_{epoch:09d}"
        load_files(spark, tables, product, paths, batch_id, files_per_step=files_per_step)

    return (
        found.writeStream.foreachBatch(run)
        .queryName(f"{product.name}-{uuid.uuid4().hex}")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_available(
    spark: SparkSession, tables: Tables, product: Product, landing: str, checkpoint: str, compact_after: int = 20,
    **options,
) -> None:
    """Load everything that has landed, fold the change sets together when there are many, then return."""
    query = watch(spark, tables, product, landing, checkpoint, **options)
    query.awaitTermination()
    staging_table(tables, product).compact(compact_after)


def watch_entries(
    spark: SparkSession, tables: Tables, product: Product, landing: str, checkpoint: str, pattern: str = "*.zip",
    entries_per_block: int = 10_000, blocks_per_batch: int = 10,
) -> None:
    """Load every entry of the landed archives that is not loaded yet, then return; a stopped load goes on inside an archive.

    Two streams follow each other. The first one lists the entries of new archives, unread, into files of
    ``entries_per_block`` entries; the second one loads ``blocks_per_batch`` of these files at a time. What its checkpoint
    has is an offset in the entries of all archives: a load that is broken off repeats the blocks of one batch at most.
    Blocks come in the order of archives and places, where the file system lets times be set.
    """
    if product.listed is None or product.read_listed is None:
        raise ValueError(f"entries of {product.name} archives cannot be listed: they have one each")
    place = checkpoint.rstrip("/")

    def list_blocks(paths: DataFrame, epoch: int) -> None:
        listing = product.listed(paths.distinct())
        # A repeated epoch writes other file names: those of the first attempt are gone before the second stream starts.
        ordered = listing.repartitionByRange("archive", "pos").sortWithinPartitions("archive", "pos")
        ordered.write.mode("overwrite").option("maxRecordsPerFile", entries_per_block).parquet(f"{place}/blocks/epoch-{epoch:09d}")
        in_order(spark, f"{place}/blocks/epoch-{epoch:09d}")

    found = _landed(spark, landing, pattern, 1000)
    found.writeStream.foreachBatch(list_blocks).option("checkpointLocation", f"{place}/listing").trigger(availableNow=True).start().awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/blocks")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return

    def load(listing: DataFrame, epoch: int) -> None:
        load_listed(spark, tables, product, listing, f"{batch_prefix(product, _query_id(spark, f'{place}/loading'))}_{epoch:09d}")

    blocks = spark.readStream.schema(ENTRIES).option("maxFilesPerTrigger", blocks_per_batch).parquet(f"{place}/blocks/*")
    blocks.writeStream.foreachBatch(load).option("checkpointLocation", f"{place}/loading").trigger(availableNow=True).start().awaitTermination()


def in_order(spark: SparkSession, folder: str) -> None:
    """Give a folder's files times in the order of their names: a stream takes the older ones first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((s for s in fs.listStatus(path) if s.getPath().getName().startswith("part-")), key=lambda s: s.getPath().getName())
    latest = max((s.getModificationTime() for s in files), default=0)
    for k, s in enumerate(files):
        fs.setTimes(s.getPath(), latest - 1000 * (len(files) - 1 - k), -1)


def pause(spark: SparkSession, tables: Tables, query: StreamingQuery) -> str | None:
    """Stop a running load after the micro-batch in hand is dropped, and log that batch as paused; returns its id.

    The batch in hand is the first one of the stream that has no completed state. Starting ``watch`` again with the same
    checkpoint continues with it. A load that has ended already is not paused.
    """
    if not query.isActive:
        return None
    product = PRODUCTS[query.name.split("-", 1)[0]]
    prefix = batch_prefix(product, str(query.id))
    query.stop()
    own = current_batches(ingestion_log(spark, tables.ingestion_log)).where(F.col("batch_id").startswith(f"{prefix}_"))
    done = F.max(F.when(F.col("status").isin(COMPLETED, WITH_ERRORS), F.substring_index("batch_id", "_", -1).cast("long")))
    last = own.agg(done.alias("n")).first()["n"]
    batch_id = f"{prefix}_{0 if last is None else last + 1:09d}"
    begun = own.where(F.col("batch_id") == batch_id).first()
    state = begun.asDict() if begun else {"batch_id": batch_id, "search_name": SEARCH_NAME, "started_at": _now(), "files_completed": 0}
    log_batch(spark, tables.ingestion_log, state | {"status": PAUSED, "error_message": None, "completed_at": None, "logged_at": _now()})
    return batch_id


def load_manifest(spark: SparkSession, tables: Tables, files: DataFrame, batch_id: str) -> tuple[list[dict], DataFrame]:
    """Load a list of files ``(product, url)``: companies first, since the others need them.

    Returns the log rows and the entries that name no known product or no address. One pass per product, not per file.
    """
    files = settle(files.select("product", "url"), "manifest")
    good, bad = split(files, manifest_rules())
    states = []
    for name, product in PRODUCTS.items():
        paths = good.where(F.col("product") == name).select(F.col("url").alias("path"))
        if not paths.isEmpty():
            states.append(load_files(spark, tables, product, paths, f"{batch_id}_{name}"))
    return states, bad
