"""Token ids in Arrow files of equal-length sequences with masks.

Documents are dealt by ranges of doc_id and sorted, so the files, in order of
their number, hold the ids of all documents in ascending doc_id order.  A file
is an Arrow file of record batches with two columns of fixed-size lists: ids
(the narrowest unsigned type for the vocabulary) and mask (a bit for each id,
false for the padding after a file's last one).  All batches but the last hold equally
many sequences, so a sequence's place follows from its number and a mapped
file gives it without a copy.  An index table has each document's file, first
place and number of ids.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: Ids of a sequence, and sequences of a record batch.
LENGTH, BATCH = 1024, 64
#: A worker keeps the ids of so many words and of so many parts of words; then it forgets them and begins anew.
WORDS_KEPT, PARTS_KEPT = 400_000, 600_000
_INDEX = "doc_id long, part int, path string, start long, n_tokens long"
_PUNCTUATION = r"[!-&(-/:-@\[-`{-~]*"


def _place(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":" in path else f"file://{path}")


class _Parts(dict):
    """The ids, as bytes, of each part of a word that the tokenizer's model takes."""

    def __init__(self, model, kind):
        self.model, self.kind = model, kind

    def __missing__(self, part: str) -> bytes:
        if len(self) >= PARTS_KEPT:
            self.clear()
        out = self[part] = np.array([t.id for t in self.model.tokenize(part)], self.kind).tobytes()
        return out


class Encoder(dict):
    """Encodes texts with a tokenizer of the tokenizers library, without special tokens added.

    A tokenizer that parts words at white space and drops it gives a text's ids
    word by word, so each word is encoded once and then remembered.  Others
    encode whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype(np.uint16 if max(self.tokenizer.get_vocab().values()) < 1 << 16 else np.uint32)
        made = json.loads(self.tokenizer.to_str())
        first = (made["pre_tokenizer"] or {}).get("pretokenizers", [made["pre_tokenizer"] or {}])[0]
        self.by_word = first.get("type") == "Split" and first.get("behavior") == "Removed" and r"\s" in str(first.get("pattern")) and not any(t["lstrip"] or t["rstrip"] for t in made["added_tokens"])
        if self.by_word:
            # Texts with special tokens or with what only Python takes for white space are encoded whole.
            self.whole = (*(t["content"] for t in made["added_tokens"]), "\x1c", "\x1d", "\x1e", "\x1f")
            self.parts = _Parts(self.tokenizer.model, self.kind)
            # Letters that the tokenizer, too, takes one by one, whatever stands beside them, with what its model sees of them.
            letters = {c: self._seen(c) for c in map(chr, range(0x41, 0x250)) if c.isalpha()}
            self.letters = {ord(c): seen for c, seen in letters.items() if seen and self._seen(f"x{c}y") == f"x{seen}y"}
            self.plain = re.compile("([" + "".join(map(chr, self.letters)) + f"]+)({_PUNCTUATION})") if self.letters else None

    def _seen(self, text: str) -> str | None:
        parts = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text)
        return parts[0][0] if len(parts) == 1 else None

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS_KEPT:
            self.clear()
        if self.plain and (m := self.plain.fullmatch(word)):
            out = self.parts[m[1].translate(self.letters)] + (self.parts[m[2]] if m[2] else b"")
        else:
            out = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.kind).tobytes()
        if len(word) < 64:
            self[word] = out
        return out

    def ids(self, text: str) -> np.ndarray:
        if self.by_word and not any(s in text for s in self.whole):
            return np.frombuffer(b"".join(map(self.__getitem__, text.split())), self.kind)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)


class SequenceWriter:
    """Packs ids into sequences and writes them batch by batch."""

    def __init__(self, sink, kind: np.dtype, length: int, batch: int):
        value = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))], metadata={"length": str(length), "batch": str(batch)})
        self.file, self.kind, self.length, self.size = pa.ipc.new_file(sink, self.schema), kind, length, length * batch
        self.held, self.n_held, self.n = [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n += len(ids)
        if self.n_held >= self.size:
            flat = np.concatenate(self.held)
            for at in range(0, len(flat) - self.size + 1, self.size):
                self._write(flat[at : at + self.size], self.size)
            rest = flat[len(flat) // self.size * self.size :].copy()
            self.held, self.n_held = [rest], len(rest)

    def _write(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        self.file.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)], schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            flat = np.zeros(-(-self.n_held // self.length) * self.length, self.kind)
            flat[: self.n_held] = np.concatenate(self.held)
            self._write(flat, self.n_held)
        self.file.close()


class Sequences:
    """Random access to one file's sequences: ``self[k]`` is (ids, mask), an array and an Arrow array, views of the file where it can be mapped."""

    def __init__(self, path: str):
        files, at = _place(path)
        self.source = pa.memory_map(at) if isinstance(files, pa.fs.LocalFileSystem) else files.open_input_file(at)
        self.file = pa.ipc.open_file(self.source)
        self.length, self.batch = (int(self.file.schema.metadata[k]) for k in (b"length", b"batch"))

    def __len__(self) -> int:
        n = self.file.num_record_batches
        return (n - 1) * self.batch + self.file.get_batch(n - 1).num_rows if n else 0

    def _flat(self, batch: int) -> np.ndarray:
        return self.file.get_batch(batch).column(0).flatten().to_numpy(zero_copy_only=True)

    def __getitem__(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if not 0 <= k < len(self):
            raise IndexError(k)
        batch, at = k // self.batch, k % self.batch * self.length
        return self._flat(batch)[at : at + self.length], self.file.get_batch(batch).column(1).flatten().slice(at, self.length)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from a place in the file on, across sequences and batches."""
        size, out = self.length * self.batch, []
        while n > 0:
            part = self._flat(start // size)[start % size : start % size + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)

    def close(self) -> None:
        self.source.close()


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, length: int = LENGTH, batch: int = BATCH) -> DataFrame:
    """Encode all texts into Arrow files below ``folder``, which driver and executors share; return the index.

    The index has doc_id, part (the file's number), path, start (place of the
    first id in the file) and n_tokens of every row, and lies in the folder,
    too.  Rows are in ascending order of doc_id, nulls first, then of their
    texts' hashes.  ``end_id`` follows each document.  Null and empty texts are
    that id alone; repeated rows are written again; an empty table gives an
    empty index and no file; other columns are ignored.  A task that runs again
    writes a new file, and files that no row of the index names are deleted.
    """
    spark, vocabulary = docs.sparkSession, tokenizer or public_tokenizers.path(VOCABULARY)
    data = f"{folder.rstrip('/')}/data"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder, out = TaskContext.get().partitionId(), None, None
        for rows in batches:
            if not rows.num_rows:
                continue
            if out is None:
                encoder = _encoder(vocabulary)
                files, at = _place(path := f"{data}/part-{part:06d}-{uuid.uuid4().hex}.arrow")
                files.create_dir(at.rpartition("/")[0], recursive=True)
                out = SequenceWriter(sink := files.open_output_stream(at), encoder.kind, length, batch)
                end = np.array([end_id], encoder.kind)
            starts = [out.n]
            for text in rows.column("text"):
                out.add(encoder.ids(text.as_py() or ""))
                out.add(end)
                starts.append(out.n)
            n = rows.num_rows
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([part] * n, pa.int32()), pa.array([path] * n), pa.array(starts[:-1], pa.int64()), pa.array(np.diff(starts), pa.int64())], ["doc_id", "part", "path", "start", "n_tokens"])
        if out is not None:
            out.close()
            sink.close()

    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*key).sortWithinPartitions(*key)
    rows.mapInArrow(run, _INDEX).write.parquet(f"{folder.rstrip('/')}/index")
    index = read_index(spark, folder)
    kept = {r["path"].rpartition("/")[2] for r in index.select("path").distinct().collect()}  # one row a file
    files, at = _place(data)
    for found in files.get_file_info(pa.fs.FileSelector(at, allow_not_found=True)):
        if found.base_name not in kept:
            files.delete_file(found.path)
    return index


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_INDEX).parquet(f"{folder.rstrip('/')}/index")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document from the files: doc_id, start (ids of all documents before it), n_tokens and ids (32-bit little-endian)."""
    index = read_index(spark, folder)
    # One row a file, so the window over all of them is short.
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, held = None, None
        for rows in batches:
            for at in range(0, rows.num_rows, 512):  # keeps the outgoing batches small
                part, ids = rows.slice(at, 512), []
                for path, start, n in zip(part.column("path").to_pylist(), part.column("start").to_pylist(), part.column("n_tokens").to_pylist()):
                    if path != opened:
                        if held:
                            held.close()
                        opened, held = path, Sequences(path)
                    ids.append(held.ids(start, n).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), part.column("start"), part.column("n_tokens"), pa.array(ids, pa.binary())], ["doc_id", "part", "start", "n_tokens", "ids"])
        if held:
            held.close()

    n = index.select("part").distinct().count()
    read = index.repartitionByRange(max(1, n), "part", "start").mapInArrow(run, "doc_id long, part int, start long, n_tokens long, ids binary")
    return read.join(broadcast_if_small(before), "part").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids")


def delete(folder: str) -> None:
    files, at = _place(folder)
    files.delete_dir(at)
