"""Token counts of flat token files, by a scan for separators.

A token file is a flat run of little-endian 16- or 32-bit ids without header or
index; an end-of-document id closes each document. Files are cut into blocks.
A task reads its block, finds the separators with one vectorised comparison,
and reports the whole documents inside and the open ends at both sides. A
prefix scan over the blocks of a file (their sums are few and small) stitches
documents that cross block boundaries, however many blocks they span.
"""

from __future__ import annotations

import base64
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitlens.llm.common import sliced, stage
from hitlens.llm.warc import _open

BLOCK_TOKENS = 1 << 20


def write_token_files(documents: DataFrame, ranks: bytes, pattern: str, end: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """Encode the texts of documents (doc_id, text) with the byte-level BPE of a
    rank file and write them to flat files of 16-bit ids in folder, a file for
    each task, every text closed by `end`. A null text is empty: the end id
    alone. Repeated rows and rows without an id are written each; an empty
    table writes no file.

    Result, staged: files (file, tokens) and places (file, ordinal, doc_id), a
    row for each document in its file's order. Files of lost attempts have
    other names and are in neither.
    """

    def run(batches):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        if max(*table.values(), end) > 0xFFFF:
            raise ValueError("the ids do not fit 16 bits")
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        files, folder_at = _open(folder)
        files.create_dir(folder_at, recursive=True)
        name, out, tokens, docs = f"{uuid.uuid4().hex}.tok", None, 0, 0

        def rows(ordinals, doc_ids, total):
            columns = pa.array([name] * len(ordinals), pa.string()), pa.array(ordinals, pa.int64()), doc_ids, pa.array([total] * len(ordinals), pa.int64())
            return pa.RecordBatch.from_arrays(list(columns), names=["file", "ordinal", "doc_id", "tokens"])

        for batch in sliced(batches):
            if out is None:
                out = files.open_output_stream(f"{folder_at}/{name}", compression=None)
            for text in batch.column(1).to_pylist():
                ids = np.array([*encode(text or ""), end], "<u2")
                out.write(ids.tobytes())
                tokens += len(ids)
            yield rows(range(docs, docs + batch.num_rows), batch.column(0), None)
            docs += batch.num_rows
        if out is not None:
            out.close()
            # the file itself, once it is whole
            yield rows([-1], pa.array([None], pa.int64()), tokens)

    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    written = stage(texts.mapInArrow(run, "file string, ordinal long, doc_id long, tokens long"), "files")
    return written.filter("ordinal < 0").select("file", "tokens"), written.filter("ordinal >= 0").select("file", "ordinal", "doc_id")


def scan_blocks(files: DataFrame, folder: str, end: int, width: int = 2, block: int = BLOCK_TOKENS) -> DataFrame:
    """For each block of files (file, tokens): file, block, n (tokens), ends
    (separators in it), head (tokens up to and with the first separator, or all),
    tail (tokens after the last separator, or all) and inner (lengths of the
    documents that lie between its separators, their separators included)."""

    def run(batches):
        source_fs, folder_at = _open(folder)
        for batch in sliced(batches, 64):
            out = []
            for file, number, n in zip(*(c.to_pylist() for c in batch.columns)):
                with source_fs.open_input_file(f"{folder_at}/{file}") as f:
                    ids = np.frombuffer(f.read_at(n * width, number * block * width), f"<u{width}")
                at = np.flatnonzero(ids == end)
                out.append((file, number, n, len(at), int(at[0]) + 1 if len(at) else n, n - 1 - int(at[-1]) if len(at) else n, np.diff(at)))
            columns = list(zip(*out)) if out else [()] * 7
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file", "block", "n", "ends", "head", "tail", "inner"])

    blocks = files.filter("tokens > 0").select("file", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / block))).alias("block"))
    work = blocks.select("file", "block", F.least(F.lit(block).cast("long"), F.col("tokens") - F.col("block") * block).alias("n"))
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return work.repartition(tasks, "file", "block").mapInArrow(run, "file string, block long, n long, ends long, head long, tail long, inner array<long>")


def document_lengths(files: DataFrame, folder: str, end: int, width: int = 2, block: int = BLOCK_TOKENS) -> DataFrame:
    """The documents of flat token files (file, tokens): file, ordinal (from 0),
    n_tokens (with the separator), closed.

    Tokens after a file's last separator are a last document that is not closed.
    A file without tokens has no documents. Two separators in a row close an
    empty document of one token.
    """
    scanned = stage(scan_blocks(files, folder, end, width, block), "blocks")
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy("file").orderBy(F.desc("block"))
    # sums of blocks, not tokens: open is what earlier blocks leave to the next separator
    sums = scanned.select("file", "block", "n", "ends", "head", "tail")
    carried = (
        sums.withColumn("start", F.col("block") * block)
        .withColumn("before", F.coalesce(F.sum("ends").over(order), F.lit(0)))
        .withColumn("left", F.last(F.when(F.col("ends") > 0, F.col("start") + F.col("n") - F.col("tail")), ignorenulls=True).over(order))
        .withColumn("is_last", F.row_number().over(last) == 1)
        .withColumn("opened", F.coalesce("left", F.lit(0)))
    )
    rows = carried.join(scanned.select("file", "block", "inner"), ["file", "block"])
    lengths = F.when(F.col("ends") > 0, F.concat(F.array(F.col("start") + F.col("head") - F.col("opened")), F.col("inner"))).otherwise(F.array().cast("array<bigint>"))
    rest = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("start") + F.col("n") - F.col("opened"))
    rows = rows.withColumn("lengths", F.when(F.col("is_last") & (rest > 0), F.array_append(lengths, rest)).otherwise(lengths))
    return rows.select("file", "before", "ends", F.posexplode("lengths").alias("i", "n_tokens")).select(
        "file", (F.col("before") + F.col("i")).alias("ordinal"), "n_tokens", (F.col("i") < F.col("ends")).alias("closed")
    )
