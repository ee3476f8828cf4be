"""Filling containers of fixed capacity with texts: bounded-space online best fit."""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import spread

#: Folder of the public tokenizers and the rank file that sizes are counted with.
TOKENIZERS, RANKS = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Containers kept open at a time, texts that one stream of containers takes, and the most capacities of one call.
OPEN_BINS, SHARD_ROWS, MOST_LIMITS = 256, 50_000, 1000
_SHARD_BITS = 24


@lru_cache(maxsize=2)
def _encoding(folder: str, ranks: str):
    """The tokenizer, read once per worker."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("ledgerloom_public_tokenizers", Path(folder) / "__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(Path(folder) / ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=module.PATTERN, mergeable_ranks=table, special_tokens={})


def token_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """``doc_id`` and ``tokens`` of every text by a public tokenizer; null texts have 0 tokens. One pass, no shuffle."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(folder, ranks).encode_ordinary
        for b in batches:
            n = [0 if t is None else len(encode(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "tokens"])

    return spread(src).mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, tokens long")


def estimated_tokens(n_chars: Column, per_token: float = 3.6) -> Column:
    """The project's own estimate: characters by ``per_token``, rounded half to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(n_chars / F.lit(per_token), 0)).cast("long")


class BestFit:
    """An online packer. Bit ``f`` of ``free`` is set while some open container has ``f`` tokens of space left."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.free, self.bins, self.open, self.made = 0, {}, 0, 0

    def put(self, size: int) -> int:
        """The container for an item of at most ``capacity``: the open one with the least sufficient space, else a new one.

        When as many are open as may be, the fullest is closed first.
        """
        above = self.free >> size
        if above:
            space = size + (above & -above).bit_length() - 1
            held = self.bins[space]
            chosen = held.pop()
            if not held:
                self.free &= ~(1 << space)
            self.open -= 1
        else:
            if self.open >= self.limit:
                self._close_fullest()
            chosen, space = self.made, self.capacity
            self.made += 1
        left = space - size
        if left:
            self.bins.setdefault(left, []).append(chosen)
            self.free |= 1 << left
            self.open += 1
        return chosen

    def _close_fullest(self) -> None:
        space = (self.free & -self.free).bit_length() - 1
        held = self.bins[space]
        held.pop()
        if not held:
            self.free &= ~(1 << space)
        self.open -= 1


def pack(sizes: DataFrame, limits: DataFrame, open_bins: int = OPEN_BINS, shard_rows: int = SHARD_ROWS, most_limits: int = MOST_LIMITS) -> DataFrame:
    """The container of every text for every capacity: ``limit_name``, ``doc_id``, ``piece``, ``container``, ``tokens``.

    ``sizes`` has ``doc_id`` and ``tokens``; ``limits`` has ``limit_name`` and ``capacity_tokens`` (at most ``most_limits``
    rows, checked, since every text is packed for each). Texts go to streams of about ``shard_rows`` by a hash of their id and size, and each stream is packed in
    hash order as it is read: a task keeps ``open_bins`` containers, not the texts, so no group can grow too large, and the
    result is the same however often a task is run. Only ids and sizes are shuffled, never texts. A text beyond the capacity
    fills whole containers of its own with pieces of that size; its rest is packed like a text. Container numbers are
    unique within a limit. Texts of 0 tokens take no space but have a container; a null size counts as 0; capacities that are
    null or below 1 are left out; repeated rows are packed each.
    """
    caps = [(r["limit_name"], int(r["capacity_tokens"])) for r in limits.where("capacity_tokens > 0").select("limit_name", "capacity_tokens").limit(most_limits + 1).collect()]
    if len(caps) > most_limits:
        raise ValueError(f"more than {most_limits} capacities")
    schema = f"limit_name string, doc_id {sizes.schema['doc_id'].dataType.simpleString()}, piece int, container long, tokens long"
    if not caps:
        return sizes.sparkSession.createDataFrame([], schema)
    rows = sizes.select("doc_id", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    shards = max(1, -(-rows.count() // shard_rows))
    order = F.xxhash64("doc_id", "tokens")
    rows = rows.select("doc_id", "tokens", order.alias("_order"), F.pmod(order, F.lit(shards)).cast("int").alias("_shard"))
    each = F.explode(F.array(*[F.lit(k) for k in range(len(caps))])).alias("_cap")
    streams = rows.select("*", each).repartition("_cap", "_shard").sortWithinPartitions("_cap", "_shard", "_order", "doc_id", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packer, base = None, None, 0
        for b in batches:
            names, taken, pieces, homes, sizes_ = [], [], [], [], []
            for k, (size, shard, cap) in enumerate(zip(*(b.column(c).to_pylist() for c in (1, 3, 4)))):
                if (cap, shard) != now:
                    now, base = (cap, shard), shard << (63 - _SHARD_BITS)
                    packer = BestFit(caps[cap][1], open_bins)
                name, capacity = caps[cap]
                parts = [capacity] * (size // capacity) + ([size % capacity] if size % capacity or not size else [])
                for piece, part in enumerate(parts):
                    names.append(name)
                    taken.append(k)
                    pieces.append(piece)
                    homes.append(base + packer.put(part))
                    sizes_.append(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), b.column(0).take(pa.array(taken, pa.int64())), pa.array(pieces, pa.int32()), pa.array(homes, pa.int64()), pa.array(sizes_, pa.int64())],
                ["limit_name", "doc_id", "piece", "container", "tokens"],
            )

    return streams.mapInArrow(run, schema)


def fill_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """Per limit: pieces, containers, tokens, the least containers that could do, and the share of space used (6 places)."""
    used = packed.groupBy("limit_name", "container").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("p"))
    total = used.groupBy("limit_name").agg(F.sum("p").alias("n_pieces"), F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("tokens"), F.max("t").alias("most"))
    both = total.join(limits.select("limit_name", F.col("capacity_tokens").cast("long").alias("capacity")), "limit_name")
    return both.select("limit_name", "capacity", "n_pieces", "n_containers", "tokens", "most", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"), F.round(F.col("tokens") / (F.col("capacity") * F.col("n_containers")), 6).alias("fill"))


def invariants(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """Per limit what must hold: ``n_docs`` and ``tokens`` placed, ``n_overfull`` containers beyond the capacity, ``n_split`` texts in pieces though they fit (both 0)."""
    caps = limits.select("limit_name", F.col("capacity_tokens").cast("long").alias("capacity"))
    full = packed.groupBy("limit_name", "container").agg(F.sum("tokens").alias("t")).join(caps, "limit_name").groupBy("limit_name").agg(F.count_if(F.col("t") > F.col("capacity")).alias("n_overfull"))
    texts = packed.groupBy("limit_name", "doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("p")).join(caps, "limit_name")
    placed = texts.groupBy("limit_name").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("t").alias("tokens"), F.count_if((F.col("p") > 1) & (F.col("t") <= F.col("capacity"))).alias("n_split"))
    return placed.join(full, "limit_name").select("limit_name", "n_docs", "tokens", F.col("n_overfull").cast("int").alias("n_overfull"), F.col("n_split").cast("int").alias("n_split"))
