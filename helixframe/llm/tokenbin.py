"""Token-ID output: documents as integer runs in ORC stripes.

Documents are ranged and sorted by id, encoded, and written as ORC: token ids
are integer-run-length encoded, ``doc_id`` has row indexes and Bloom filters, so
that a reader takes stripes in parallel and skips those without the ids it asks
for.  Each row also holds where its document begins within its shard (one task's
file); a shard's own beginning is the sum of those before it.

Null and empty texts are documents of the end id alone.  A null id sorts first.
Rows of equal id are ordered by a hash of their text, so repeated rows stand
side by side.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .storage import scratch_path, shuffle_partitions

#: Words whose ids a worker keeps, but for those that one call adds.
WORD_CACHE = 500_000
SIGNS = b'.,;:!?*#%&$@)"]'
#: Bytes that byte-level pieces don't write as the Latin-1 character of that number, with the one that they do: U+0100 and on.
_MOVED = [*range(33), *range(127, 161), 173]
MOVED = [(chr(b), chr(256 + i)) for i, b in enumerate(_MOVED) if b > 127]


def is_latin(word: bytes) -> bool:
    """Lower-case letters up to U+024F only."""
    text = word.decode()
    return text.isalpha() and max(text) < "\u0250" and text == text.lower()


class Encoder:
    """A tokenizers file as a function from texts to id arrays.

    If the file lower-cases and never lets a token cross white space, ids of
    words are kept and reused, as words repeat far more than texts do.  When
    ``words`` holds half of what may be kept it becomes ``older``, from which
    words that are met again come back; so frequent words always stay.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = self._splits_at_space(spec)
        if self.by_word:
            self.bare = Tokenizer(self.whole.model)
            self.bare.pre_tokenizer = WhitespaceSplit()
            suffix, vocabulary = spec["model"]["end_of_word_suffix"], self.whole.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @staticmethod
    def _splits_at_space(spec: dict) -> bool:
        """True for: NFC, white space folded, lower-cased; letters, digits and signs split apart; byte-level pieces."""
        normal = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        pattern = splits[0].get("pattern", {}).get("Regex", "") if splits else ""
        return normal == ["NFC", "Replace", "Lowercase"] and pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and splits[0].get("behavior") == "Removed" and spec.get("post_processor") is None and bool(spec["model"].get("end_of_word_suffix"))

    def _direct(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _by_model(self, found: list[bytes]) -> None:
        """Adds words ``found`` of lower-case Latin letters, or of signs only.

        The file's normalisers leave them as they are and don't split them, so many
        are one text for the bare model; a word ends where its token says so.
        """
        words = self.words
        for i in range(0, len(found), 1000):
            text = b" ".join(found[i : i + 1000])
            latin = not text.isascii()
            text = text.decode("latin-1")
            for byte, char in MOVED if latin else ():
                text = text.replace(byte, char)
            ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            raw, last = ids.tobytes(), 0
            for w, end in zip(found[i : i + 1000], (4 * np.flatnonzero(self.ends[ids]) + 4).tolist(), strict=True):
                words[w] = raw[last:end]
                last = end

    def _together(self, pieces: list[bytes]) -> None:
        """Adds other words, encoded 512 at a time and told apart by where their tokens stand."""
        for i in range(0, len(pieces), 512):
            some = [x.decode() for x in pieces[i : i + 512]]
            starts = np.cumsum([0] + [len(x) + 1 for x in some])
            got = self.whole.encode("\n".join(some), add_special_tokens=False)
            ids = np.array(got.ids, dtype="<u4")
            at = np.searchsorted(np.array([a for a, _ in got.offsets], dtype=np.int64), starts).tolist()
            for k, x in enumerate(pieces[i : i + 512]):
                self.words[x] = ids[at[k] : at[k + 1]].tobytes()

    def _learn(self, missing: set[bytes]) -> None:
        """Adds words to the cache."""
        plain = list(filter(bytes.isalpha, missing))
        rest = missing.difference(plain)
        signs = [w for w in rest if not w.strip(SIGNS)]
        latin = list(filter(is_latin, rest.difference(signs)))
        self._by_model(plain)
        self._by_model(latin)
        self._by_model(signs)
        self._together(list(rest.difference(signs, latin)))

    def _known(self, found: list[bytes]) -> list[bytes]:
        """The ids of words: of letters with trailing signs, those of the letters and of the signs, which are kept apart."""
        if len(self.words) > WORD_CACHE // 2:
            self.older, self.words = self.words, {}
        out = list(map(self.words.get, found))
        new = [i for i, ids in enumerate(out) if ids is None]
        cores = [found[i].rstrip(SIGNS) for i in new]
        signed = [len(c) < len(found[i]) and (c.isalpha() or is_latin(c)) for i, c in zip(new, cores, strict=True)]
        cores = [c if s else found[i] for i, c, s in zip(new, cores, signed, strict=True)]
        signs = [found[i][len(c) :] for i, c in zip(new, cores, strict=True)]  # none of a word that stays whole
        missing = {*cores, *signs} - {b""}
        missing.difference_update(self.words)
        again = missing & self.older.keys()
        self.words.update(zip(again, map(self.older.get, again), strict=True))
        self._learn(missing - again)
        for i, core, sign in zip(new, cores, signs, strict=True):
            out[i] = self.words[core] + self.words[sign] if sign else self.words[core]
        return out

    def rows(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by ``end``, and where each text's begin.  A word is looked up once, however often it stands in them."""
        apart = pc.fill_null(pc.match_substring(texts, "<|"), False) if self.by_word else pc.is_valid(texts)  # "<|": may be a special token
        data, offsets = K.text_buffers(pc.if_else(apart, "", texts))
        words = K.find_words(K.LOWER[data], offsets)
        size = words.end - words.start
        column = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)])), pa.py_buffer(words.data[K.SPACED[words.data]])])
        column = column.dictionary_encode()
        raw, at = (column.dictionary.buffers()[2] or b"").to_pybytes() if len(size) else b"", np.frombuffer(column.dictionary.buffers()[1] or b"", dtype=np.int64)[: len(column.dictionary) + 1].tolist()
        values = [*self._known([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]), end]
        closing = np.full(len(texts), len(values) - 1)
        for row in np.flatnonzero(apart.to_numpy(zero_copy_only=False)).tolist():
            closing[row] = len(values)
            values.append(self._direct(texts[row].as_py()) + end)
        order = np.insert(column.indices.to_numpy().astype(np.int64), words.first[1:], closing)
        bounds = np.concatenate([[0], np.cumsum(np.array(list(map(len, values)))[order])])[np.concatenate([[0], words.first[1:] + np.arange(1, len(texts) + 1)])]
        flat = pa.array(values, pa.large_binary()).take(pa.array(order))
        return np.frombuffer(flat.buffers()[2] or b"", dtype="<u4"), bounds // 4

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        ids, bounds = self.rows(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker and file."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Frees the words that this worker has kept, as reading needs none."""
    _encoders.clear()


#: Bytes of texts encoded at once, and ids in one Arrow batch on the way to the file.
TEXT_AT_ONCE, IDS_AT_ONCE = 3 << 20, 1 << 20


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, stripe_bytes: int = 16 << 20, index_stride: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes ORC rows (doc_id, ids, n_tokens, shard, shard_start) under ``path``, in ascending id order."""
    ours = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    ranged = ours.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        ours, end, shard, start = encoder(tokenizer), end_id.to_bytes(4, "little"), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, names = batch["text"], batch["doc_id"]
            size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
            for i, j in K.chunks(texts, size, TEXT_AT_ONCE):
                ids, bounds = ours.rows(texts.slice(i, j - i), end)
                for a, b in K.chunks(ids, bounds, IDS_AT_ONCE):
                    at = bounds[a : b + 1]
                    lists = pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(ids[at[0] : at[-1]].view("<i4")))
                    yield pa.record_batch({"doc_id": names.slice(i + a, b - a), "ids": lists, "n_tokens": pa.array(np.diff(at)), "shard": pa.array(np.full(b - a, shard, dtype=np.int32)), "shard_start": pa.array(start + at[:-1])})
                start += int(bounds[-1])

    rows = ranged.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, ids array<int>, n_tokens long, shard int, shard_start long")
    options = {"compression": "zstd", "orc.stripe.size": stripe_bytes, "orc.row.index.stride": index_stride, "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": 0.01}
    rows.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``write_tokens`` with ``start``: the ids of all documents before."""
    rows = spark.read.orc(path)
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))  # a row a file
    return rows.join(F.broadcast(offsets), "shard").select("doc_id", "ids", "n_tokens", (F.col("offset") + F.col("shard_start")).alias("start"))


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (crc32 of the ids as little-endian unsigned 32-bit integers)."""
    id_type = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches):
        forget()
        for batch in batches:
            ids = batch["ids"]
            values, bounds = ids.values.to_numpy(zero_copy_only=False).view("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.record_batch({"doc_id": batch["doc_id"], "start": batch["start"], "n_tokens": pa.array(np.diff(bounds).astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())})

    return tokens.select("doc_id", "start", "ids").mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the files to the shared folder, reads them back, and digests what they hold."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return digest(read_tokens(spark, path))
