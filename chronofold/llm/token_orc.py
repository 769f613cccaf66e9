"""Token ids in ORC: ordered stripes, integer run-length encoding, Bloom filters on document ids.

Documents are dealt into ranges of doc_id, sorted, encoded, and written by Spark's ORC writer, one
file per range. ORC stores the ids in its run-length encoding, keeps minima and maxima of doc_id
for every stripe and row group, and a Bloom filter for look-ups of single ids; readers take stripes
in parallel and skip those that metadata excludes. A small table of ids per file gives each
document's place in the whole sequence, so nothing is rewritten once counts are known.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ForcedBoundaryBPE, load
from .common import text_batches, tidy


def split_words(bpe: ForcedBoundaryBPE, text: str | None) -> list[str]:
    """Fragments under a vocabulary that drops white space: its runs are cuts too.

    A text that holds a special token, or a separator that Python takes for a blank and the
    vocabulary doesn't, is one fragment.
    """
    if not text:
        return []
    if (bpe.marks and bpe.marks.search(text)) or bpe.separators.search(text):
        return [text]
    return text.split() if bpe.uncuttable(text) else bpe.bare.findall(text)


def word_ids(bpe: ForcedBoundaryBPE, texts: list[str | None]) -> Iterator[bytes]:
    """Packed ids of whole texts."""
    return bpe.packed(texts, lambda text: split_words(bpe, text))


#: Slots of a word table, bytes up to which a word is kept in it, ids after which it is emptied, and words that go to the library as one text.
SLOTS, KEPT_BYTES, POOL, JOINED = 1 << 20, 23, 8_000_000, 2000
_BLANK, _SIGN, _WORD, _OTHER, _ODD = range(5)


class WordTable:
    """Ids of words in a bounded open table of numpy arrays, looked up for all words of a batch at once.

    A key is the word's bytes with their count, in three 64-bit lanes, so a hit is exact. Texts of
    ASCII and Latin letters are cut at white space and signs by byte classes, under the conditions
    of split_words; every other text, and a word too long for a key, goes through word_ids.
    """

    def __init__(self, bpe: ForcedBoundaryBPE, end_id: int):
        self.bpe, self.end_id = bpe, end_id
        ends = [k for t, k in bpe.library.get_vocab().items() if bpe.suffix and t.endswith(bpe.suffix)]
        self.ends = np.zeros(max(bpe.library.get_vocab().values()) + 1, dtype=bool)
        self.ends[ends] = True
        kind = np.full(256, _ODD, dtype=np.uint8)
        for b in range(0x80):
            c = chr(b)
            kind[b] = _BLANK if c in " \t\n\v\f\r" else _ODD if b < 0x20 or b == 0x7F else _WORD if c.isalnum() else _SIGN if bpe.sign.fullmatch(c) else _OTHER
        kind[0x80:0xC0] = _WORD  # later bytes of characters; the first ones decide
        kind[0xC3:0xCA] = _WORD  # U+00C0 to U+027F, letters but for U+00D7, U+00F7 and, when in lower case, U+0130
        self.kind = kind
        self.masks = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
        self.empty()

    def empty(self) -> None:
        self.keys = np.zeros((3, SLOTS), dtype=np.uint64)
        self.start, self.size = np.zeros(SLOTS, dtype=np.int32), np.zeros(SLOTS, dtype=np.int32)
        self.pool, self.filled = np.full(1 << 16, self.end_id, dtype=np.uint32), 1

    def _append(self, ids: np.ndarray) -> int:
        """Place of ids in the pool; the first entry of the pool is the end id."""
        at, self.filled = self.filled, self.filled + len(ids)
        if self.filled > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), dtype=np.uint32)])
        self.pool[at : self.filled] = ids
        return at

    def _exactly(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places and sizes of the ids of whole texts."""
        found = [np.frombuffer(x, dtype="<u4") for x in word_ids(self.bpe, texts)]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        at = self._append(np.concatenate(found) if found else np.zeros(0, dtype=np.uint32))
        return at + np.cumsum(sizes) - sizes, sizes

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places and sizes of the ids of words.

        Those of letters are encoded as one text. Each has one end of word at least, so where there
        are as many ends as words, the ends part the words; else they are encoded one by one.
        """
        starts, sizes = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        plain = np.fromiter(map(str.isalpha, words), dtype=bool, count=len(words))
        alone, joined = np.flatnonzero(~plain).tolist(), np.flatnonzero(plain)
        for k in range(0, len(joined), JOINED):
            some = joined[k : k + JOINED]
            ids = np.array(self.bpe.library.encode_batch_fast([" ".join([words[x] for x in some.tolist()])], add_special_tokens=False)[0].ids, dtype=np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(some) and last[-1] == len(ids) - 1:
                sizes[some] = n = np.diff(last, prepend=-1)
                starts[some] = self._append(ids) + last + 1 - n
            else:
                alone += some.tolist()
        if alone:
            each = [e.ids for e in self.bpe.library.encode_batch_fast([words[x] for x in alone], add_special_tokens=False)]
            sizes[alone] = n = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
            starts[alone] = self._append(np.array([x for ids in each for x in ids], dtype=np.uint32)) + np.cumsum(n) - n
        return starts, sizes

    def _look_up(self, raw: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and sizes of the ids of the words at start, of at most KEPT_BYTES bytes."""
        padded = np.frombuffer(raw + bytes(24), dtype=np.uint8)
        each = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        lanes = np.empty((3, len(start)), dtype=np.uint64)
        for k in range(3):
            lanes[k] = each[start + 8 * k] & self.masks[np.clip(size - 8 * k, 0, 8)]
        lanes[2] |= size.astype(np.uint64) << np.uint64(56)
        mixed = (lanes[0] * np.uint64(0x9E3779B97F4A7C15)) ^ (lanes[1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (lanes[2] * np.uint64(0x165667B19E3779F9))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        slots = [(mixed >> np.uint64(44)).astype(np.int64), ((mixed >> np.uint64(20)) & np.uint64(SLOTS - 1)).astype(np.int64)]
        at, n = np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64)
        left = np.arange(len(start))
        while len(left):
            for slot in slots:
                s = slot[left]
                hit = (self.keys[0, s] == lanes[0, left]) & (self.keys[1, s] == lanes[1, left]) & (self.keys[2, s] == lanes[2, left])
                at[left[hit]], n[left[hit]] = self.start[s[hit]], self.size[s[hit]]
                left = left[~hit]
            if len(left):
                new = left[np.unique(mixed[left], return_index=True)[1]]
                words = [raw[a : a + b].decode() for a, b in zip(start[new].tolist(), size[new].tolist(), strict=True)]
                where, sizes = self._learn(words)
                s = np.where(self.size[slots[0][new]] == 0, slots[0][new], slots[1][new])
                # Where two new words meet in a slot, the last stays; the other is looked for again.
                kept = np.unique(s[::-1], return_index=True)[1]
                kept = len(s) - 1 - kept
                s, new = s[kept], new[kept]
                self.keys[:, s] = lanes[:, new]
                self.start[s], self.size[s] = where[kept], sizes[kept]
        return at, n

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Counts of ids of the texts, the end id included, and all their ids."""
        if self.filled > POOL:
            self.empty()
        texts = texts.cast(pa.large_string()).fill_null("")
        count = len(texts)
        off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + count + 1]
        raw = bytes(memoryview(texts.buffers()[2])[off[0] : off[-1]]) if off[-1] > off[0] else b""
        off = off - off[0]
        data = np.frombuffer(raw, dtype=np.uint8)
        kind = self.kind[data]
        pair = np.flatnonzero((kind[1:] ^ kind[:-1]) == (_SIGN ^ _OTHER))
        pair = pair[((kind[pair] == _SIGN) & (kind[pair + 1] == _OTHER)) | ((kind[pair] == _OTHER) & (kind[pair + 1] == _SIGN))]
        latin, dotted = np.flatnonzero(data[:-1] == 0xC3), np.flatnonzero(data[:-1] == 0xC4)
        odd = [np.flatnonzero(kind == _ODD), pair, latin[(data[latin + 1] == 0x97) | (data[latin + 1] == 0xB7)], dotted[data[dotted + 1] == 0xB0]]
        for mark in self.bpe.special:
            mark, found = mark.encode(), raw.find(mark.encode())
            while found >= 0:
                odd.append(np.array([found]))
                found = raw.find(mark, found + 1)
        whole = np.unique(np.searchsorted(off, np.concatenate(odd), side="right") - 1)
        for d in whole.tolist():
            kind[off[d] : off[d + 1]] = _BLANK
        kind[kind == _OTHER] = _WORD
        turn = np.ones(len(kind) + 1, dtype=bool)
        turn[1:-1] = kind[1:] != kind[:-1]
        turn[off] = True
        cuts = np.flatnonzero(turn)
        start, size = cuts[:-1], np.diff(cuts)
        seen = kind[start] != _BLANK
        start, size = start[seen], size[seen]
        at, n = np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64)
        short = size <= KEPT_BYTES
        at[short], n[short] = self._look_up(raw, start[short], size[short])
        if not short.all():
            at[~short], n[~short] = self._exactly([raw[a : a + b].decode() for a, b in zip(start[~short].tolist(), size[~short].tolist(), strict=True)])
        doc = np.searchsorted(off, start, side="right") - 1
        if len(whole):
            more = self._exactly([raw[off[d] : off[d + 1]].decode() for d in whole.tolist()])
            order = np.argsort(doc := np.concatenate([doc, whole]), kind="stable")
            doc, at, n = doc[order], np.concatenate([at, more[0]])[order], np.concatenate([n, more[1]])[order]
        every, sizes = np.zeros(len(doc) + count, dtype=np.int64), np.ones(len(doc) + count, dtype=np.int64)
        place = np.arange(len(doc)) + doc
        every[place], sizes[place] = at, n
        stop = np.cumsum(sizes)
        ids = self.pool[np.repeat(every - stop + sizes, sizes) + np.arange(stop[-1] if len(stop) else 0)]
        return np.bincount(doc, weights=n, minlength=count).astype(np.int64) + 1, ids


@lru_cache(maxsize=1)
def word_table(path: str, end_id: int) -> WordTable:
    return WordTable(load(path), end_id)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 64 << 20) -> None:
    """Write (doc_id, n_tokens, ids) in ascending doc_id order to ORC files under path.

    Every document gets end_id at its end; a null or empty text is end_id alone. Null doc_ids come
    first, rows of one doc_id stay together in one file. An empty table writes empty files.
    """
    spark = docs.sparkSession
    text_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(vocabulary, end_id)
        try:
            for batch in batches:
                sizes, flat = table.encode(batch.column("text"))
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view("<i4")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), ids], names=["doc_id", "n_tokens", "ids"])
        finally:
            table.bpe.forget()
            table.empty()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    encoded = ordered.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids array<int>")
    options = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.stripe.size": str(stripe_bytes)}
    encoded.write.options(**options).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, n_tokens, ids) of some documents: the predicate reaches stripe statistics and Bloom filters."""
    return spark.read.schema("doc_id long, n_tokens long, ids array<int>").orc(path).where(F.col("doc_id").isin(doc_ids))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read from the files under path.

    Each file is read stripe by stripe; a task that begins inside a file needs the ids before its
    first row, which come from the counts alone (the n_tokens column), not from the ids.
    """
    rows = spark.read.schema("doc_id long, n_tokens long, ids array<int>").orc(path)
    place = rows.select("doc_id", "n_tokens", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    sums = place.groupBy("file", "block").agg(F.sum("n_tokens").alias("total"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    listed = sorted(sums.collect(), key=lambda r: (r["low"] is not None, r["low"] or 0, r["high"] or 0, r["file"], r["block"]))
    bases, at = {}, 0
    for r in listed:
        bases[r["file"], r["block"]] = at
        at += r["total"]
    # One entry per split of a file, as a scan plans them anyway; documents are never listed.
    known = spark.sparkContext.broadcast(bases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, at = None, 0
        for batch in batches:
            starts, crcs = [], []
            lists = batch.column("ids")
            values = np.asarray(lists.values).astype("<i4", copy=False)
            offsets = np.asarray(lists.offsets)
            files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
            for k in range(batch.num_rows):
                if (files[k], blocks[k]) != place:
                    place = (files[k], blocks[k])
                    at = known.value[place]
                ids = values[offsets[k] : offsets[k + 1]]
                starts.append(at)
                crcs.append(zlib.crc32(ids.tobytes()))
                at += len(ids)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(starts, pa.int64()), batch.column("n_tokens"), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    full = rows.select("doc_id", "n_tokens", "ids", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return full.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
