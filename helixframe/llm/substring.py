"""Substring dedup: repeated fixed-length word windows are found anywhere and cut out.

Every window of every document gets a rolling Rabin-Karp hash.  Documents are
dealt to blocks by a hash of their id and text; a block sends the sorted
distinct hashes of its windows, packed 8 bytes each, to the hash ranges they
fall in.  A range counts them over all blocks and answers with one bit a hash.
The windows whose bit is set are asked for once more, by a second hash whose
words' hashes and multiplier are others; each block then cuts those that are
again found elsewhere, merged into maximal intervals.  Words aren't compared.
Words' hashes are sums of a random number for each byte and place, so no pattern
makes unlike words meet; a window's polynomial modulo 2**64 has 45 good bits at
worst (two words that alternate like the Thue-Morse sequence), 64 otherwise, and
both rounds must fail for a wrong cut.  A hash that a third of all
windows share is sent once by a block, so no range grows with it.  Blocks and
ranges are numbered by bytes of text, so a group's size is bounded.

Null and empty texts have no words: nothing is removed and the kept text is
empty.  Repeated rows and repeated ids are documents of their own.  Rows of equal
id and text that together exceed a block aren't dealt to one: all their words
go (if a window fits), and one row stands for them in the counts.  A text longer
than a block is a group of its own, handled in pieces but for its window hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import shuffle_partitions, written

SPANS = "array<struct<start:int,end:int>>"
WORDS = r"[^\x20\x09-\x0D]+"
#: Bytes of text, about, for a block and for a range of hashes.
BLOCK_BYTES, RANGE_BYTES = 32 << 20, 64 << 20
OTHER_SEED = 1


def block_windows(text: pa.ChunkedArray, width: int, base: int = K.WORD_BASE, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Window hashes of a block, the word at which each starts, the first word of each row, and the texts' bytes and bounds."""
    data, offsets = K.text_buffers(text)
    found, starts, firsts, seen = [], [], [np.zeros(1, dtype=np.int64)], 0
    for i, j in K.chunks(data, offsets, 4 * K.PIECE):
        words = K.find_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        hashes = K.hash_windows(K.hash_words(words, seed=seed), width, base)
        inside = np.flatnonzero(K.window_starts(words.first, width))
        found.append(hashes[inside])
        starts.append(inside + seen)
        firsts.append(words.first[1:] + seen)
        seen += len(words.start)
    empty = [np.zeros(0, dtype=np.uint64)]
    return np.concatenate(found or empty), np.concatenate(starts or [np.zeros(0, dtype=np.int64)]), np.concatenate(firsts), [data, offsets]


def range_bounds(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the 2**bits ranges begins in sorted keys."""
    return np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def remove_repeats(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, n_words, removed (word intervals, end exclusive), kept_text.

    A word goes if a window of ``width`` words that covers it also starts
    anywhere else; windows are judged on the input.
    """
    spark = docs.sparkSession
    size = F.octet_length(text_col).cast("long")
    same = docs.groupBy(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash")).agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("rows"))
    total = same.agg(F.sum("size")).first()[0] or 0
    blocks = max(2 * shuffle_partitions(spark), -(-total // BLOCK_BYTES))
    bits = max(1, (2 * shuffle_partitions(spark) - 1).bit_length(), (total // RANGE_BYTES).bit_length())
    id_type = docs.schema[id_col].dataType
    ours = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # each holds over BLOCK_BYTES of text, so they are fewer than the blocks
    hot = written(same.where((F.col("rows") > 1) & (F.col("size") > BLOCK_BYTES)).select("id", "text_hash", F.lit(True).alias("hot")), "hot-rows")
    has_hot = bool(hot.head(1))
    alone = None
    if has_hot:
        marked = ours.withColumn("text_hash", F.xxhash64("text"))
        met = marked["id"].eqNullSafe(hot["id"]) & (marked["text_hash"] == hot["text_hash"])
        alone = marked.join(F.broadcast(hot), met, "left_semi").select("id", "text")
        stand_in = alone.dropDuplicates(["id", "text"]).select("id", "text", F.explode(F.array(F.lit(True), F.lit(True))).alias("extra"))
        ours = marked.join(F.broadcast(hot), met, "left_anti").select("id", "text", F.lit(False).alias("extra")).unionByName(stand_in)
    else:
        ours = ours.withColumn("extra", F.lit(False))
    ours = ours.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))

    def sent_keys(block: int, hashes: np.ndarray) -> pa.Table:
        keys, counts = np.unique(hashes, return_counts=True)
        at = range_bounds(keys, bits)
        full = np.flatnonzero(np.diff(at))
        parts = [(keys[at[r] : at[r + 1]].tobytes(), np.packbits(counts[at[r] : at[r + 1]] > 1).tobytes()) for r in full]
        return pa.table({"range": pa.array(full, pa.int32()), "block": pa.array([block] * len(full), pa.int64()), "keys": pa.array([p[0] for p in parts], pa.binary()), "twice": pa.array([p[1] for p in parts], pa.binary())})

    def repeats(hashes: np.ndarray, answers: pa.Table) -> np.ndarray:
        """Which of a block's window hashes occur anywhere else by the answers."""
        keys, which = np.unique(hashes, return_inverse=True)
        repeated = np.zeros(len(keys), dtype=bool)
        at = range_bounds(keys, bits)
        for r, mask in zip(answers["range"].to_pylist(), answers["mask"].to_pylist(), strict=True):
            repeated[at[r] : at[r + 1]] = np.unpackbits(np.frombuffer(mask, dtype=np.uint8), count=at[r + 1] - at[r])
        return repeated[which]

    def send(group: pa.Table) -> pa.Table:
        return sent_keys(group["block"][0].as_py(), block_windows(group["text"], width)[0])

    def send_again(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not answers.num_rows:
            return sent_keys(0, np.zeros(0, dtype=np.uint64))
        again = repeats(block_windows(group["text"], width)[0], answers)
        return sent_keys(group["block"][0].as_py(), block_windows(group["text"], width, K.OTHER_BASE, OTHER_SEED)[0][again])

    def counted(group: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray], list[int]]:
        """The keys sent to a range, which of them are repeated, and the senders that have any such."""
        sent = [np.frombuffer(x, dtype=np.uint64) for x in group["keys"].to_pylist()]
        twice = [np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=len(k)).astype(bool) for x, k in zip(group["twice"].to_pylist(), sent, strict=True)]
        everything = np.concatenate(sent)
        order = np.argsort(everything, kind="stable")
        ordered = everything[order]
        same = ordered[1:] == ordered[:-1]
        repeated = np.empty(len(ordered), dtype=bool)
        repeated[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        # a block that holds a window twice is the only sender of it, or else a match anyway
        repeated |= np.concatenate(twice)
        masks = np.split(repeated, np.cumsum([len(k) for k in sent])[:-1])
        return sent, masks, [i for i, m in enumerate(masks) if m.any()]

    def count(group: pa.Table) -> pa.Table:
        _, masks, hit = counted(group)
        return pa.table({"block": group["block"].take(pa.array(hit, pa.int64())), "range": group["range"].take(pa.array(hit, pa.int64())), "mask": pa.array([np.packbits(masks[i]).tobytes() for i in hit], pa.binary())})

    def confirm(group: pa.Table) -> pa.Table:
        sent, masks, hit = counted(group)
        return pa.table({"block": group["block"].take(pa.array(hit, pa.int64())), "keys": pa.array([sent[i][masks[i]].tobytes() for i in hit], pa.binary())})

    def cut(group: pa.Table, answers: pa.Table) -> pa.Table:
        hashes, starts, first, (data, offsets) = block_windows(group["text"], width, K.OTHER_BASE, OTHER_SEED)
        total = int(first[-1])
        cover = np.zeros(total + 1, dtype=np.int32)
        gone = starts[np.isin(hashes, np.frombuffer(b"".join(answers["keys"].to_pylist()), dtype=np.uint64))]
        cover[gone] += 1
        cover[gone + width] -= 1  # starts are distinct, and so are their ends
        drop = np.cumsum(cover)[:total] > 0
        spans, kept, whole, own = [], [], data.tobytes(), np.flatnonzero(~group["extra"].to_numpy())
        for i in own:
            lost = drop[first[i] : first[i + 1]]
            text = whole[offsets[i] : offsets[i + 1]].split()
            if lost.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[False], lost, [False]]).astype(np.int8)))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
                text = [w for w, x in zip(text, lost.tolist(), strict=True) if not x]
            else:
                spans.append([])
            kept.append(b" ".join(text))
        return pa.table({"id": group["id"].take(pa.array(own)), "n_words": pa.array(np.diff(first)[own], pa.int64()), "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    def by_block(answers: DataFrame, function, kind: str) -> DataFrame:
        return ours.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(function, kind)

    keys_type = "range int, block long, keys binary, twice binary"
    sent = ours.groupBy("block").applyInArrow(send, keys_type)
    again = by_block(sent.groupBy("range").applyInArrow(count, "block long, range int, mask binary"), send_again, keys_type)
    out = by_block(again.groupBy("range").applyInArrow(confirm, "block long, keys binary"), cut, f"id {id_type.simpleString()}, n_words long, removed {SPANS}, kept_text string")
    if alone is not None:
        words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORDS), 0)
        n = F.size("words")
        everything = F.when(n >= width, F.array(F.struct(F.lit(0).alias("start"), n.alias("end")))).otherwise(F.array().cast(SPANS))
        out = out.unionByName(alone.select("id", words.alias("words")).select("id", n.cast("long").alias("n_words"), everything.alias("removed"), F.when(n >= width, "").otherwise(F.array_join("words", " ")).alias("kept_text")))
    return out.withColumnRenamed("id", id_col)


def removed_words(column: str = "removed"):
    """How many words the intervals hold."""
    return F.aggregate(column, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
