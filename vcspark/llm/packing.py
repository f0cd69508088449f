"""Packing documents into windows of tokens, best-fit decreasing.

Overlong documents are first cut into full windows. Pieces fall into shards of bounded
size; in each, pieces go longest first into the tightest open window, which a segment
tree over the remaining capacities finds.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vcspark.llm.textops import batches
from vcspark.llm.tokens import encoder
from vcspark.sources.shared import save_shared

WINDOW = 1024
PIECES_PER_SHARD = 16_384


def byte_bpe_path() -> str:
    """Where this process finds the byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, path: Callable[[], str] = byte_bpe_path, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): the documents' token ids in pieces of at most ``window``.

    A document's ids are its text's (null: empty), then ``end_id``. All pieces but the
    last are full windows. ``path`` is called on the executors.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path()).encode, end_id.to_bytes(4, "little")
        for part in parts:
            for rows in batches(part, "text"):
                ids, start, size, crc, total, data = [], [], [], [], [], []
                for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
                    tokens = encode(text or "") + end
                    for at in range(0, len(tokens), 4 * window):
                        piece = tokens[at : at + 4 * window]
                        ids.append(doc_id)
                        start.append(at // 4)
                        size.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(len(tokens) // 4)
                        data.append(np.frombuffer(piece, "<u4").astype(np.int32) if keep_ids else None)
                columns = [pa.array(c, pa.int64()) for c in (ids, start, size, crc, total)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    columns, names = [*columns, pa.array(data, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if keep_ids else ""))


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window number and offset of each piece; ``lengths`` must not increase.

    A leaf of the tree holds the open windows of one remaining capacity, a node how
    many there are below it.
    """
    base = 1 << window.bit_length()
    count = [0] * (2 * base)
    free: list[list[int]] = [[] for _ in range(window + 1)]
    numbers, offsets, opened = [], [], 0
    for length in lengths:
        node = base + length
        found = bool(count[node])
        while not found and node > 1:  # up, until there is an open window to the right
            found = not node & 1 and bool(count[node + 1])
            node = node + 1 if found else node >> 1
        if found:
            while node < base:
                node = 2 * node + (not count[2 * node])
            capacity = node - base
            number = free[capacity].pop()
            at = node
            while at:
                count[at] -= 1
                at >>= 1
        else:
            number, capacity, opened = opened, window, opened + 1
        numbers.append(number)
        offsets.append(window - capacity)
        if capacity > length:
            free[capacity - length].append(number)
            at = base + capacity - length
            while at:
                count[at] += 1
                at >>= 1
    return numbers, offsets


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """``pieces`` (doc_id, start, length, ...; at most ``window`` long) with sequence_id and offset.

    Sequences are filled from offset 0 without gaps. Shards hold about
    ``PIECES_PER_SHARD`` pieces, dealt by the hash of piece and document, so no
    document or source gathers in one. Rows that repeat are packed each for itself,
    null ids like others. Only piece sizes travel here; ``pieces`` is read twice, so
    it should be a saved table.
    """
    shards = max(1, -(-pieces.count() // PIECES_PER_SHARD))

    def run(part: pa.Table) -> pa.Table:
        part = part.take(pc.sort_indices(part, [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")]))
        shard = part.column("shard")[0].as_py() * 2**32
        number, offset = best_fit(part.column("length").to_pylist(), window)
        placed = part.append_column("sequence_id", pa.array([shard + n for n in number], pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
        return placed.drop_columns(["shard"])

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards))).groupBy("shard").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, path: Callable[[], str] = byte_bpe_path) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one id long, so every row of ``docs`` has a piece. Texts
    of any length are read whole. Other columns are not read.
    """
    return pack(save_shared(cut_pieces(docs, id_col, text_col, window, path), "pack-pieces"), window)


def assemble(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, used): the windows' ids, padded with ``pad_id`` to ``window`` unless their number is a power of two.

    ``packed`` needs the pieces' ids (``cut_pieces(keep_ids=True)``).
    """
    whole = packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))
    used = whole.withColumn("used", F.size("ids"))
    short = (F.bit_count("used") > 1) & (F.col("used") < window)
    return used.select("sequence_id", F.when(short, F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(window) - F.col("used")))).otherwise(F.col("ids")).alias("ids"), "used")
