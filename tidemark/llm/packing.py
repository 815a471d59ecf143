"""Best-fit packing of token sequences, merged up a tree.

The leaves of the tree are groups of about `per_task` pieces, packed best-fit decreasing. Bins that are nearly full are done;
the others go on as items (a bin with its members) to the node above, where neighbouring groups meet and are packed
again, up to the root or until that no longer saves bins. A node holds about `per_task` items at any level: there are as many
as the items left need, so no task ever sees the whole corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, chunks, give_back, lets_go
from tidemark.llm.tokens import ByteBpe

#: Bytes of text that a task tokenises at once; the kernels take 30 to 50 times as much.
BLOCK_BYTES = 1 << 19

_encoders: dict[str, ByteBpe] = {}


def piece_bounds(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a first that may be shorter."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def batch_pieces(batch: pa.RecordBatch, enc: ByteBpe, capacity: int, end_id: int) -> pa.RecordBatch:
    """The pieces of a batch of (key, text)."""
    tail = np.array([end_id], "<u4").tobytes()
    row, piece, start, length, crc = [], [], [], [], []
    for a, b, buf, offs in chunks(batch.column(1), BLOCK_BYTES):
        ids, at = enc.encode(buf, offs)
        raw, at = ids.astype("<u4").tobytes(), at.tolist()
        for i in range(b - a):
            own = raw[4 * at[i] : 4 * at[i + 1]] + tail
            for p, (s, n) in enumerate(piece_bounds(len(own) // 4, capacity)):
                row.append(a + i)
                piece.append(p)
                start.append(s)
                length.append(n)
                crc.append(zlib.crc32(own[4 * s : 4 * (s + n)]))
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["k", "piece", "start", "length", "ids_crc32"]
    )


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, key: str, text: str) -> DataFrame:
    """(k, piece, start, length, ids_crc32) of every document's ids followed by end_id."""
    kind = docs.schema[key].dataType.simpleString()

    @lets_go
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = ByteBpe(tokenizer)
            give_back()  # what reading the vocabulary took
        for batch in batches:
            yield batch_pieces(batch, _encoders[tokenizer], capacity, end_id)

    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, f"k {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of item numbers) by best fit over items in falling size: each goes where least room is left over.
    Open bins are kept by room; a bit mask of the rooms in use finds the tightest one in constant time."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, []
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        size = sizes[i]
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        room -= size
        if room:
            open_bins[room].append(b)
            mask |= 1 << room
    return bins


def _pack_round(items: DataFrame, kind: str, capacity: int, level: int) -> DataFrame:
    """items: (node, n, filled, members) -> (node, n, filled, members): the bins of each node. n numbers items and bins;
    equal sizes go by it, so that a retried task packs alike."""
    member = f"array<struct<k:{kind},piece:int,start:long,length:long,ids_crc32:long>>"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("filled", "descending"), ("n", "ascending")]).combine_chunks()
        lists = table.column("members").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.chunk(0)
        at, flat = lists.offsets.to_numpy(), lists.values
        sizes, node = table.column("filled").to_numpy(), table.column("node")[0].as_py()
        bins = best_fit(sizes.tolist(), capacity)
        order = [k for b in bins for i in b for k in range(at[i], at[i + 1])]
        counts = [sum(int(at[i + 1] - at[i]) for i in b) for b in bins]
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        return pa.table(
            {
                "node": pa.array(np.full(len(bins), node, np.int64)),
                "n": pa.array((level << 56) + (node << 28) + np.arange(len(bins), dtype=np.int64)),
                "filled": pa.array([int(sizes[b].sum()) for b in bins], pa.int64()),
                "members": pa.ListArray.from_arrays(offsets, flat.take(pa.array(order, pa.int64()))),
            }
        )

    return items.groupBy("node").applyInArrow(run, f"node long, n long, filled long, members {member}")


def pack(
    docs: DataFrame, tokenizer: str, scratch: Scratch, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text",
    nearly_full: int = 8, per_task: int = 8192,
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and end_id; only one longer than capacity is cut (full pieces, the first may be shorter). A
    null or empty text is end_id alone. Equal and repeated documents are packed each on its own. An empty table
    gives no rows. Extra columns are ignored. Bins with at most nearly_full free places are closed at once. Which of
    several equal pieces lands where follows partition order; the packing itself is written, so all readers see one. A null
    key is packed like any other. Ties of size go by row number.
    """
    kind = docs.schema[key].dataType.simpleString()
    pieces = token_pieces(docs, tokenizer, capacity, end_id, key, text)
    member = F.struct("k", "piece", "start", "length", "ids_crc32")
    # rows are numbered as they are written: repeated rows spread over the leaves like any others
    carry = scratch.table(pieces.select(F.monotonically_increasing_id().alias("n"), F.col("length").alias("filled"), F.array(member).alias("members")), "pieces")
    left = carry.count()
    nodes, level, done = max(1, -(-left // per_task)), 1, []
    carry = carry.withColumn("node", F.pmod(F.xxhash64("n"), F.lit(nodes)))
    while True:
        packed = scratch.table(_pack_round(carry, kind, capacity, level), f"level{level}")
        underfull = F.col("filled") < capacity - nearly_full
        now = packed.where(underfull).count()
        if nodes == 1 or now == 0 or now > 0.98 * left:
            done.append(packed)
            break
        done.append(packed.where(~underfull))
        # neighbouring nodes meet in the one above; where no fewer nodes will do, bins change their partners
        above = max(1, -(-now // per_task))
        up = F.floor(F.col("node") * above / nodes) if above < nodes else F.pmod(F.xxhash64("n"), F.lit(above))
        carry = packed.where(underfull).withColumn("node", up.cast("long"))
        nodes, left, level = above, now, level + 1
    out = reduce(DataFrame.unionByName, done).withColumnRenamed("n", "sequence_id")
    # offsets run over a bin's members in order
    spots = F.expr("transform(sequence(1, size(members)), i -> struct(members[i-1] as m, aggregate(slice(members, 1, i-1), 0L, (s, x) -> s + x.length) as o))")
    rows = out.select("sequence_id", F.explode(spots).alias("s"))
    return rows.select(F.col("s.m.k").alias(key), "s.m.piece", "s.m.start", "s.m.length", "s.m.ids_crc32", "sequence_id", F.col("s.o").alias("offset"))
