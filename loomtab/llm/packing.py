"""Filling fixed-capacity containers: conflict-constrained best fit.

Texts are measured in tokens of a public tokenizer. A text longer than a container is cut into full containers and a
rest; nothing else is split. The pieces are spread by hash over packing tasks of about ``bins_a_task`` containers; bins
are kept by their residual room, with bits for each source and each cluster of copies (texts that agree in letters and
digits) that say which bins may take no more of it. From the smallest sufficient residual upwards the search
continues until the tightest bin is found that may take the piece; if there is none, a new bin is opened.

The conflicts are a constraint: with ``n`` pieces of a source (or cluster) and ``m`` bins as the tokens need at least, a bin takes
``ceil(n / m)`` of them, that is one, unless counting shows that some bin must hold more. Long pieces come first; pieces of
frequent sources count as longer (``hard``), so that they are spread before the room gets scarce. :func:`fill_report` states fill and conflicts.

Copies and texts of a hot source are spread over all tasks, and a task's size is bounded by ``bins_a_task``.

Defined cases: null texts and texts without tokens need no container; extra columns are ignored; a null source is a source of
its own; equal ids are equal texts' rows and are placed each; an empty table gives no row.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtab.session import cut

#: Path of the tokenizer where the setting ``spark.loomtab.tokenizer`` names none; the file is sent to the executors with the job.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: By how much the pieces of a source that every bin must hold count as longer.
HARD = 4.0
_MARKS = re.compile(r"[\W_]+")
#: The published pattern of byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def measure(docs: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, tokens, source, cluster) of each text; cluster is a hash of the text's letters and digits.

    ``tokenizer``: path of a tokenizer's ranks that the driver can read.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or spark.conf.get("spark.loomtab.tokenizer", TOKENIZER)
    spark.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        enc = encoding(SparkFiles.get(name))
        for b in it:
            texts = b.column(1).to_pylist()
            known: dict[int, int] = {}
            tokens, clusters = [], []
            for t in texts:
                h = xxhash.xxh3_64_intdigest(t)
                if h not in known:
                    known[h] = len(enc.encode_ordinary(t))
                tokens.append(known[h])
                clusters.append(xxhash.xxh3_64_intdigest(_MARKS.sub("", t.lower())) - (1 << 63))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens, pa.int64()), b.column(2), pa.array(clusters, pa.int64())], ["doc_id", "tokens", "source", "cluster"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(source).cast("string"), F.lit(""))).alias("source"))
    return rows.where("text is not null").mapInArrow(run, "doc_id long, tokens long, source long, cluster long")


def _limits(group: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each piece how many pieces its group has, and how many of them one bin must take at most if they are spread over so many bins."""
    _, at, n = np.unique(group, return_inverse=True, return_counts=True)
    return n[at], -(-n[at] // max(bins, 1))


def best_fit(size: np.ndarray, source: np.ndarray, cluster: np.ndarray, capacity: int, hard: float = HARD) -> np.ndarray:
    """The bin of each piece: the tightest one whose source and cluster bits allow it, otherwise a new one."""
    out = np.zeros(len(size), np.int64)
    least = -(-int(size.sum()) // capacity)
    of_source, most_source = _limits(source, least)
    of_cluster, most_cluster = _limits(cluster, least)
    by_room: dict[int, int] = {}  # residual → bits of the bins that have it
    rooms = 0  # bit r is set if a bin has residual r
    shut: tuple[dict[int, int], dict[int, int]] = ({}, {})  # bits of the bins that have enough of a source, of a cluster
    held: tuple[dict, dict] = ({}, {})
    count = 0
    order = np.lexsort((cluster, source, -size * (1 + hard * np.minimum(np.maximum(of_source, of_cluster) / max(least, 1), 1))))
    for i, s, src, cl, ms, mc in zip(order.tolist(), *(x[order].tolist() for x in (size, source, cluster, most_source, most_cluster))):
        wrong = shut[0].get(src, 0) | shut[1].get(cl, 0)
        found, left = -1, rooms >> s << s
        while left:
            r = (left & -left).bit_length() - 1
            if ok := by_room[r] & ~wrong:
                found = (ok & -ok).bit_length() - 1
                break
            left &= left - 1
        if found < 0:
            found, r = count, capacity
            count += 1
        else:
            by_room[r] &= ~(1 << found)
            if not by_room[r]:
                rooms &= ~(1 << r)
        if room := r - s:
            by_room[room] = by_room.get(room, 0) | 1 << found
            rooms |= 1 << room
        for k, (group, most) in enumerate(((src, ms), (cl, mc))):
            n = 1 if most == 1 else held[k].get((group, found), 0) + 1
            if most > 1:
                held[k][group, found] = n
            if n >= most:
                shut[k][group] = shut[k].get(group, 0) | 1 << found
        out[i] = found
    return out


def pack(measured: DataFrame, capacity: int = 4096, bins_a_task: int = 2000) -> DataFrame:
    """(doc_id, piece, tokens, container, source, cluster) of each piece of each measured text."""
    held = cut(measured.where("tokens > 0"))
    total = held.agg(F.sum("tokens")).first()[0] or 0
    tasks = max(1, -(-total // (capacity * bins_a_task)))
    pieces = held.select(
        "doc_id", "source", "cluster",
        F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / capacity)), lambda k: F.least(F.lit(capacity).cast("long"), F.col("tokens") - k * capacity))).alias("piece", "size"),
    )
    routed = pieces.withColumn("task", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(tasks)).cast("int"))

    def fill(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        col = {c: t[c].to_numpy() for c in ("doc_id", "piece", "size", "source", "cluster")}
        b = best_fit(col["size"], col["source"], col["cluster"], capacity)
        return pa.table({"doc_id": col["doc_id"], "piece": col["piece"].astype(np.int32), "tokens": col["size"], "container": b + (int(key[0].as_py()) << 32), "source": col["source"], "cluster": col["cluster"]})

    return routed.groupBy("task").applyInArrow(fill, "doc_id long, piece int, tokens long, container long, source long, cluster long")


def fill_report(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row: containers, the least number the tokens need, the share of the room that is used, and conflicts.

    ``same_source`` and ``same_cluster`` are the pieces beside another one of their source, or cluster, in a container;
    ``least_same_source`` is their number if each source were spread over all containers as evenly as can be.
    """
    bins = packed.groupBy("container").agg(F.sum("tokens").alias("used"))
    one = F.count(F.lit(1))
    out = bins.agg(one.alias("containers"), F.ceil(F.sum("used") / capacity).alias("least"), (F.sum("used") / (one * capacity)).alias("filled"), F.max("used").alias("fullest"))
    for group in ("source", "cluster"):
        twice = packed.groupBy("container", group).agg((one - 1).alias("n"))
        out = out.crossJoin(F.broadcast(twice.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(f"same_{group}"))))  # one row beside one row
    of_source = packed.groupBy("source").agg(one.alias("n")).crossJoin(F.broadcast(bins.agg(one.alias("m"))))
    return out.crossJoin(F.broadcast(of_source.agg(F.coalesce(F.sum(F.greatest(F.col("n") - F.col("m"), F.lit(0))), F.lit(0)).alias("least_same_source"))))
