"""Filling containers of fixed capacity with documents, measured in tokens (problem 7)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import require_columns
from .tokenize import TOKENIZER, TOKENIZER_DIR, token_counts

#: Containers that a packer keeps open at once.
OPEN_BINS = 64
#: Documents that one packer should get; the number of packers follows from the number of documents.
DOCS_PER_PACKER = 100_000


class BestFit:
    """Bounded-space online best fit. Open bins hang in lists by their free space, and a bitset has a bit for
    each free space that occurs: shifting it by an item's size and taking the lowest bit gives the tightest
    bin. When too many are open, the fullest closes; a bin without space closes at once."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: dict[int, list[int]] = {}
        self.bits = self.open = self.used = 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        bin_ = stack.pop()
        if not stack:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_

    def _put(self, bin_: int, free: int) -> None:
        if not free:
            return
        self.by_free.setdefault(free, []).append(bin_)
        self.bits |= 1 << free
        self.open += 1
        if self.open > self.open_bins:
            self._take((self.bits & -self.bits).bit_length() - 1)

    def add(self, size: int) -> tuple[int, int]:
        """(bin, position in it) of an item of 1 to capacity tokens."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            bin_, free, self.used = self.used, self.capacity, self.used + 1
        self._put(bin_, free - size)
        return bin_, self.capacity - free

    def pieces(self, size: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(part, token offset, tokens, bin, position) of a document; only one longer than the capacity has several parts."""
        part = offset = 0
        while True:
            n = min(size - offset, self.capacity)
            yield (part, offset, n, *self.add(n))
            part, offset = part + 1, offset + n
            if offset >= size:
                return


def pack_documents(
    documents: DataFrame,
    capacities: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    pack_id: str = "pack_id",
    capacity: str = "capacity_tokens",
    open_bins: int = OPEN_BINS,
    docs_per_packer: int = DOCS_PER_PACKER,
    tokenizer_dir: str = TOKENIZER_DIR,
    tokenizer: str = TOKENIZER,
) -> DataFrame:
    """(pack_id, container_id, position, doc_id, part, token_offset, n_tokens): where each document goes, for
    every capacity.

    Positions are token offsets in the container; parts of one container neither overlap nor pass its
    capacity. Only a document longer than the capacity is split: full containers, then its rest. Documents
    without tokens (null or empty text) take no space and are left out; so are capacities that are null or
    below 1. `capacities` is a small dimension; it is collected.

    Texts are tokenised where they are read. What is shuffled is (document, length): hashed to packers that
    each get about `docs_per_packer` documents, so the bins a packer leaves open weigh little, and sorted,
    so that a task that is run again packs the same way. A packer streams; its memory is its open bins. A
    document that holds a third of all tokens only makes one packer's output longer.
    """
    require_columns(documents, doc_id, text)
    require_columns(capacities, pack_id, capacity)
    limits = sorted((p, int(c)) for p, c in capacities.select(pack_id, capacity).distinct().collect() if c is not None and c >= 1 and p is not None)
    packers = max(1, round(documents.count() / docs_per_packer))
    sizes = token_counts(documents, doc_id, text, tokenizer_dir, tokenizer).where("n_tokens > 0")
    cell = F.pmod(F.xxhash64(F.col(doc_id), F.col("n_tokens")), F.lit(packers)).cast("int")
    spread = sizes.withColumn("cell", cell).repartition(packers, "cell").sortWithinPartitions("cell", F.xxhash64(F.col(doc_id)), doc_id, "n_tokens")
    id_type = documents.schema[doc_id].dataType.simpleString()
    pack_type = capacities.schema[pack_id].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, bins = None, {}
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                ids, n = batch.column(0), batch.column(1).to_numpy()
                cells = batch.column(2).to_numpy()
                row, rows = [], []
                for i in range(len(n)):
                    if cells[i] != current:
                        current, bins = cells[i], {p: BestFit(c, open_bins) for p, c in limits}
                    for p, best in bins.items():
                        for part, offset, size, bin_, position in best.pieces(int(n[i])):
                            row.append(i)
                            rows.append((p, int(current), bin_, position, part, offset, size))
                if not rows:
                    continue
                p, c, b, position, part, offset, size = zip(*rows, strict=True)
                container = [f"{x}-{y}-{z}" for x, y, z in zip(p, c, b, strict=True)]
                columns = [pa.array(p), pa.array(container), pa.array(position, pa.int32()), ids.take(pa.array(np.array(row))), pa.array(part, pa.int32()), pa.array(offset, pa.int64()), pa.array(size, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["pack_id", "container_id", "position", "doc_id", "part", "token_offset", "n_tokens"])

    out = spread.select(F.col(doc_id).alias("doc_id"), "n_tokens", "cell").mapInArrow(
        run, f"pack_id {pack_type}, container_id string, position int, doc_id {id_type}, part int, token_offset bigint, n_tokens int"
    )
    return out.withColumnsRenamed({"pack_id": pack_id, "doc_id": doc_id})
