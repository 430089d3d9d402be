"""Token ids of documents as compressed binary files, and their reader.

Documents are sorted by ranges of ``doc_id`` over all tasks. Each task encodes its
documents and writes files of whole documents in order; the files' names give their
order. A file (all numbers little-endian) holds

- a header: ``TIDS``, version, block size, the counts of documents, ids, listed ids and blocks
- the documents: id (and whether it is null) and number of ids
- the list of the ids in use, ascending, and of the blocks: ids, bytes and crc32
- crc32 of all before
- the blocks: places in the list, coded by ``range_coder`` in blocks that start anew

``_manifest`` beside the files is a Parquet table of their counts. Files are written
under another name and moved, so that a repeated task leaves one whole file.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import range_coder
from .bpe import CHAR_OF, RARE
from .common import keyed

END_ID = 0  # fixed by the query contract
HEAD = struct.Struct("<4sIIQQQQ")
MAGIC, VERSION = b"TIDS", 1
#: Ids after which a file is closed (its last document is whole).
FILE_IDS = range_coder.LANES * range_coder.BLOCK
#: A small file has smaller blocks, as steps cost the same for few blocks as for many.
LEAST_BLOCK, FEW_BLOCKS = 256, 256
# Fixed value: the split pattern of byte-level vocabularies.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_TABLE = np.dtype([("count", "<u4"), ("size", "<u4"), ("crc", "<u4")])


class Damaged(ValueError):
    """A file or block that does not fit its checksums."""


# ------------------------------------------------------------------ text to ids
class TextEncoder:
    """Ids as the ``tokenizers`` library gives them for one vocabulary file.

    A byte-level vocabulary whose merges stand in the order of their ids is also run
    by ``tiktoken``, which takes a third of the time. Texts with a special token, or with
    characters whose class depends on the version of Unicode, go to the library itself.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self.fast = _ranked(json.load(f))

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [np.array(self.fast.encode_ordinary(text) if self._common(text)
                         else self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes() for text in texts]

    def _common(self, text: str) -> bool:
        return self.fast is not None and not RARE.search(text) and not any(s in text for s in self.special)


def _ranked(spec: dict) -> tiktoken.Encoding | None:
    """The vocabulary by ranks, if it says the same: byte-level words by the usual
    pattern, and merges in the order of the ids that they make."""
    byte_of = {c: b for b, c in CHAR_OF.items()}
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    special = {t["content"] for t in spec["added_tokens"]}
    plain = (model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True)
             and not split.get("add_prefix_space") and not spec["normalizer"]
             and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")))
    ids = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if not plain or ids != sorted(set(ids)):
        return None
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    if any(len(b) == 1 and i >= ids[0] for b, i in ranks.items()):
        return None
    return tiktoken.Encoding("from file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def loaded(path: str) -> TextEncoder:
    return TextEncoder(path)


# ------------------------------------------------------------------- the format
def file_bytes(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """One file of documents (their counts of ids add up to ``ids``)."""
    in_use = np.flatnonzero(np.bincount(ids)) if len(ids) and ids.max() < 1 << 22 else np.unique(ids)
    if len(in_use) and in_use[-1] < 1 << 22:
        place = np.zeros(int(in_use[-1]) + 1, np.uint32)
        place[in_use] = np.arange(len(in_use))
        numbers = place[ids]
    else:
        numbers = np.searchsorted(in_use, ids)
    block = range_coder.BLOCK
    while block > LEAST_BLOCK and len(ids) < FEW_BLOCKS * block:
        block //= 2
    blocks = range_coder.encode(numbers, len(in_use), block)
    table = np.array([(n, len(data), zlib.crc32(data)) for n, data in blocks], BLOCK_TABLE)
    head = b"".join([
        HEAD.pack(MAGIC, VERSION, block, len(doc_ids), len(ids), len(in_use), len(blocks)),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
        np.array(counts, "<u8").tobytes(), in_use.astype("<u4").tobytes(), table.tobytes()])
    return b"".join([head, struct.pack("<I", zlib.crc32(head)), *[data for _, data in blocks]])


def file_documents(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, counts and all ids of one file; ``Damaged`` if a checksum does not fit."""
    if len(data) < HEAD.size:
        raise Damaged("shorter than a header")
    magic, version, _, n_docs, n_ids, n_kinds, n_blocks = HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise Damaged("not a token file of this version")
    end = HEAD.size + 17 * n_docs + 4 * n_kinds + BLOCK_TABLE.itemsize * n_blocks
    if len(data) < end + 4 or zlib.crc32(data[:end]) != struct.unpack_from("<I", data, end)[0]:
        raise Damaged("header")
    at = HEAD.size

    def part(dtype, count):
        nonlocal at
        out = np.frombuffer(data, dtype, count, at)
        at += out.nbytes
        return out

    doc_ids, null, counts = part("<i8", n_docs), part("u1", n_docs), part("<u8", n_docs)
    in_use, table = part("<u4", n_kinds), part(BLOCK_TABLE, n_blocks)
    at += 4
    blocks = []
    for k, (count, size, crc) in enumerate(table.tolist()):
        coded = data[at:at + size]
        if len(coded) != size or zlib.crc32(coded) != crc:
            raise Damaged(f"block {k}")
        blocks.append((count, coded))
        at += size
    numbers = range_coder.decode(blocks, n_kinds)
    ids = in_use[np.concatenate(numbers)] if numbers else np.zeros(0, "<u4")
    if len(ids) != n_ids or int(counts.sum()) != n_ids:
        raise Damaged("counts")
    return [None if z else d for d, z in zip(doc_ids.tolist(), null.tolist())], counts.astype(np.int64), ids


# ------------------------------------------------------------------- Spark jobs
def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def _put(folder: str, name: str, data: bytes) -> None:
    """Write a file whole: a repeated task finds its file, which is the same, and leaves it."""
    files, path = _opened(folder)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        out.write(data)
    if files.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
        files.move(own, f"{path}/{name}")
    else:
        files.delete_file(own)


MANIFEST = "part long, seq long, n_docs long, n_ids long"


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Write ``doc_id`` and ``text`` of ``docs`` as token files in ascending ``doc_id``
    order, each document's ids followed by ``end_id``, into a new ``folder`` (a URI
    that the driver and all executors share).

    A null text is empty and gives the end id alone. Null ids come first; rows that
    share an id go by a hash of their text, and equal rows stand side by side. An
    empty table gives a folder without files. Other columns are not read.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(tokenizer_path)
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids, coded, size = [], [], 0

        def close():
            ids = np.frombuffer(b"".join(coded), "<u4")
            _put(folder, f"{part:08d}-{seq:08d}.ids", file_bytes(doc_ids, [len(c) // 4 for c in coded], ids))
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n_docs": len(doc_ids), "n_ids": len(ids)}])

        for batch in batches:
            for low in range(0, len(batch), 200):
                few = batch.slice(low, 200)
                found = encoder.encode(few.column("text").to_pylist())
                for doc, ids in zip(few.column("doc_id").to_pylist(), found):
                    doc_ids.append(doc)
                    coded.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= FILE_IDS:
                        yield close()
                        doc_ids, coded, size, seq = [], [], 0, seq + 1
        if doc_ids:
            yield close()

    files, path = _opened(folder)
    files.create_dir(path, recursive=True)
    # equal rows, however many, are dealt out by their place in the input; any order of them is the same
    rows = keyed(docs).withColumn("copy", F.monotonically_increasing_id())
    order = ["doc_id", "row_key", "copy"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select("doc_id", "text").mapInArrow(run, MANIFEST).write.parquet(f"{folder}/_manifest")


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) of each document in the files
    of ``folder``: ``start`` counts the ids of all documents before it. Files that do
    not fit their checksums fail with their name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                name = path.rsplit("/", 1)[-1]
                try:
                    doc_ids, counts, ids = file_documents(data.as_py())
                except (Damaged, range_coder.Damaged) as e:
                    raise Damaged(f"{path}: {e}") from e
                part, seq = map(int, name.split(".")[0].split("-"))
                ends = np.cumsum(counts)
                step = 2000
                for low in range(0, len(doc_ids), step):
                    cuts = [ids[e - n:e].tobytes() for e, n in zip(ends[low:low + step], counts[low:low + step])]
                    n = len(cuts)
                    columns = [pa.array([part] * n, pa.int64()), pa.array([seq] * n, pa.int64()),
                               pa.array(doc_ids[low:low + step], pa.int64()), pa.array(ends[low:low + n] - counts[low:low + n]),
                               pa.array(counts[low:low + n]), pa.array([zlib.crc32(c) for c in cuts], pa.int64())]
                    names = ["part", "seq", "doc_id", "before", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array(cuts, pa.binary()))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)

    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    # one row per part orders the parts; the files of a part are summed within it
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before(Window.orderBy("part")).alias("lead"))
    files = manifest.withColumnRenamed("n_ids", "n").select("part", "seq", before(Window.partitionBy("part").orderBy("seq")).alias("inner"))
    starts = files.join(parts, "part").select("part", "seq", (F.col("lead") + F.col("inner")).alias("file_start"))
    content = spark.read.format("binaryFile").load(folder).select("path", "content")
    schema = "part long, seq long, doc_id long, before long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    found = content.mapInArrow(run, schema).join(starts, ["part", "seq"])
    return found.select("doc_id", (F.col("file_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32",
                        *(["ids"] if with_ids else []))
