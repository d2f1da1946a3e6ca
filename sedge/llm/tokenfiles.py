"""Flat token files, and the token count of each document in them without an index.

A file is a run of little-endian ids of two or four bytes, as the vocabulary needs; each document ends with a separator id. Files are
cut in blocks of BLOCK_BYTES wherever that falls. A block is searched for separators with one vectorised
comparison and says how many it has and how many ids stand before its first and after its last. A prefix scan
over those summaries gives each block the number of its first document and the ids carried into
it, so documents that cross any number of blocks are stitched.
"""

from __future__ import annotations

import base64
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .durable import checkpointed, shared_dir

BLOCK_BYTES = 8 << 20
#: Blocks whose summaries are scanned together; runs of them are scanned in turn.
RUN = 4096
TEXTS_AT_ONCE = 64


def place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def id_bytes(largest: int) -> int:
    """Bytes of an id in files of a vocabulary whose largest id this is."""
    return 2 if largest < 1 << 16 else 4


def read_ranks(path: str) -> dict[bytes, int]:
    """A byte-pair vocabulary: base64 token and rank a line. Its size is the vocabulary's."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def write_token_files(docs: DataFrame, folder: str, ranks_path: str, pattern: str, separator: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode texts and write a flat file for each partition, of ids of id_bytes; returns file, ordinal, doc_id.

    ranks_path: see read_ranks; read by the driver and sent with the tasks. A file is written under a name of its attempt, then renamed, so a task that runs again
    leaves one whole file. Null and empty texts have no ids but their separator.
    """
    ranks = read_ranks(ranks_path)
    if separator in ranks.values():
        raise ValueError("the separator must be free")
    form = f"<u{id_bytes(max(separator, *ranks.values()))}"
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("doc_id", pa.int64())])

    def write(batches):
        import tiktoken
        from pyspark import TaskContext

        name = f"{TaskContext.get().partitionId():08d}.bin"
        coder = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=sent.value, special_tokens={})
        fs, root = place(folder)
        fs.create_dir(root, recursive=True)
        draft = f"{root}/.{uuid.uuid4().hex}"
        done = 0
        end = np.array([separator], form).tobytes()
        with fs.open_output_stream(draft) as out:
            for batch in batches:
                for at in range(0, len(batch), TEXTS_AT_ONCE):
                    texts = [t.as_py() or "" for t in batch["text"].slice(at, TEXTS_AT_ONCE)]
                    for ids in coder.encode_ordinary_batch(texts, num_threads=1):
                        out.write(np.array(ids, form).tobytes() + end)
                yield pa.record_batch([pa.array([name] * len(batch), pa.string()), pa.array(np.arange(done, done + len(batch))), batch["doc_id"]], schema=schema)
                done += len(batch)
        if done:
            fs.move(draft, f"{root}/{name}")
        else:
            fs.delete_file(draft)

    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return checkpointed(thin.mapInArrow(write, "file string, ordinal long, doc_id long"))


def blocks(spark: SparkSession, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, block, offset, length of the folder's token files; the driver lists names and sizes only."""
    fs, root = place(folder)
    found = fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))
    files = sorted((f.base_name, f.size) for f in found if f.is_file and f.base_name.endswith(".bin"))
    rows = spark.createDataFrame(files, "file string, size long")
    cut = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block_bytes).cast("long"))
    rows = rows.where("size > 0").select("file", "size", F.posexplode(cut).alias("block", "offset"))
    return rows.select("file", "block", "offset", F.least(F.lit(block_bytes).cast("long"), F.col("size") - F.col("offset")).alias("length"))


def count_tokens(spark: SparkSession, folder: str, separator: int, block_bytes: int = BLOCK_BYTES, width: int = 2) -> DataFrame:
    """file, ordinal, n_tokens of each document in the folder's token files.

    width: bytes of an id. Ids after a file's last separator are a last document of their own; an empty file has none. Files that do not hold
    whole ids are an error. An empty folder gives an empty result.
    """
    if block_bytes % width:
        raise ValueError("a block holds whole ids")
    schema = pa.schema([("file", pa.string()), ("block", pa.int32()), ("ids", pa.int64()), ("seps", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()), ("inner", pa.list_(pa.int64()))])

    def scan(batches):
        fs, root = place(folder)
        for batch in batches:
            for name, block, offset, length in zip(*(batch[c].to_pylist() for c in ("file", "block", "offset", "length")), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    f.seek(offset)
                    raw = f.read(length)
                if len(raw) != length or length % width:
                    raise ValueError(f"{name}: cut short or of an odd length")
                at = np.flatnonzero(np.frombuffer(raw, f"<u{width}") == separator)
                n = length // width
                head, tail = (int(at[0]), n - int(at[-1]) - 1) if len(at) else (n, n)
                yield pa.record_batch([[name], [block], [n], [len(at)], [head], [tail], [np.diff(at) - 1 if len(at) else []]], schema=schema)

    cut = blocks(spark, folder, block_bytes)
    n = max(1, cut.count())
    cut = cut.repartition(min(n, 100_000), "file", "block")
    seen = checkpointed(cut.mapInArrow(scan, "file string, block int, ids long, seps long, head long, tail long, inner array<long>"))
    # ids up to here, and where the last separator was: both scans, first over runs of blocks, then in a run
    part = seen.select("file", "block", F.floor(F.col("block") / RUN).alias("run"), "ids", "seps", F.when(F.col("seps") > 0, F.col("ids") - F.col("tail")).alias("last"))
    within = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = part.select("file", "block", "run", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"{c}_in") for c in ("ids", "seps")), "last")
    local = local.withColumn("last_in", F.max(F.col("ids_in") + F.col("last")).over(within))
    runs = local.join(part.select("file", "block", "ids", "seps"), ["file", "block"]).groupBy("file", "run").agg(
        F.sum("ids").alias("ids"), F.sum("seps").alias("seps"), F.max(F.col("ids_in") + F.col("last")).alias("last"))
    over = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("file", "run", *(F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"{c}_run") for c in ("ids", "seps")), "last")
    runs = runs.select("file", "run", "ids_run", "seps_run", F.max(F.col("ids_run") + F.col("last")).over(over).alias("last_run"))
    placed = local.drop("last").join(runs, ["file", "run"]).join(seen, ["file", "block"])
    start = F.col("ids_run") + F.col("ids_in")
    carried = start - F.coalesce(F.col("ids_run") + F.col("last_in"), F.col("last_run"), F.lit(0))
    base = F.col("seps_run") + F.col("seps_in")
    stitched = F.when(F.col("seps") > 0, F.concat(F.array(carried + F.col("head")), "inner")).otherwise(F.array().cast("array<bigint>"))
    whole = placed.select("file", base.alias("base"), F.posexplode(stitched).alias("k", "n_tokens")).select("file", (F.col("base") + F.col("k")).alias("ordinal"), "n_tokens")
    # what follows a file's last separator
    ends = placed.groupBy("file").agg(F.max_by(F.struct((base + F.col("seps")).alias("ordinal"), F.when(F.col("seps") > 0, F.col("tail")).otherwise(carried + F.col("ids")).alias("n_tokens")), "block").alias("e"))
    return whole.unionByName(ends.select("file", "e.*").where("n_tokens > 0"))


def document_token_counts(docs: DataFrame, ranks_path: str, pattern: str, separator: int, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, file, ordinal, n_tokens of docs by way of token files in the shared folder, which are deleted afterwards.

    One row for each row of docs, repeated ones and null ids too. Null and empty texts have none; texts of any length are encoded whole.
    Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    index = write_token_files(docs, folder, ranks_path, pattern, separator, id_col, text_col)
    width = id_bytes(max(separator, *read_ranks(ranks_path).values()))
    counted = checkpointed(count_tokens(spark, folder, separator, block_bytes, width))
    fs, root = place(folder)
    if fs.get_file_info(root).type != pyarrow.fs.FileType.NotFound:
        fs.delete_dir(root)
    return index.join(counted, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "n_tokens")
