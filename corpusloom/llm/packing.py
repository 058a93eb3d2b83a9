"""Packing by concatenate-and-cut.

First pass: each partition tokenizes its documents, ends each with a separator id, numbers its
tokens from 0 and writes ids and counts to shared storage. Between the passes only the token
totals of the partitions are summed, one number each, into the partitions' global offsets. Second
pass: each document knows where it stands in the one long row of tokens and is cut at the multiples
of the sequence length; a document that crosses such a bound leaves one record on either side.
Neither pass shuffles, and only the last sequence has padding.

Cases: a null text counts as empty and yields its separator alone; a null doc_id is carried through;
repeated rows are packed each; extra columns are ignored; an empty table gives no rows; long texts
are cut into as many records as they need.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bpe import WordTable, _worker, encode_window, windows
from corpusloom.llm.shared import plain, small_batches, stored

SEQUENCE_TOKENS = 1024
SEPARATOR_ID = 0
#: Words that the tokenizer library gets at once.
_LIBRARY_BATCH = 4000
#: Text that is tokenized together; beside it a worker holds the library's tokenizer, once, and the known words.
WINDOW_BYTES = 8 << 20


def _tokenizer(definition: str):
    """A worker's one tokenizer, for words and for whole texts."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return _worker(f"tokenizer {zlib.crc32(definition.encode())} {len(definition)}", lambda: Tokenizer.from_str(definition))


def library_encoder(definition: str) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """Encodes pre-tokens by the tokenizers library; a pre-token's ids don't depend on its neighbours."""
    tokenizer = _tokenizer(definition)

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        tokenizer.encode_special_tokens = True  # their strings in a word are ordinary text
        ids, counts = [], []
        for at in range(0, len(words), _LIBRARY_BATCH):
            found = [e.ids for e in tokenizer.encode_batch_fast([w.decode() for w in words[at : at + _LIBRARY_BATCH]], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter((i for x in found for i in x), np.int32, int(counts[-1].sum())))
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([np.zeros(0, np.int64), *counts])

    return encode


def added_encoder(definition: str) -> Callable[[pa.Array], dict[int, np.ndarray]]:
    """The ids, by row, of the texts that hold a string of one of the tokenizer's added tokens, as the library encodes them."""
    tokenizer = _tokenizer(definition)
    strings = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def encode(texts: pa.Array) -> dict[int, np.ndarray]:
        tokenizer.encode_special_tokens = False
        rows = set()
        for string in strings:
            rows.update(np.flatnonzero(pc.fill_null(pc.match_substring(texts, string), False).to_numpy(zero_copy_only=False)).tolist())
        return {i: np.array(tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.int64) for i in sorted(rows)}

    return encode


def tokenized(docs: DataFrame, tokenizer_path: str, separator: int = SEPARATOR_ID, added: bool = True) -> DataFrame:
    """First pass: part, local_start, doc_id, n_tokens and ids (little-endian unsigned 32-bit), separators included.
    Strings of the tokenizer's added tokens are those tokens, as the library has it; without added they are ordinary text."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    name = f"{zlib.crc32(definition.value.encode())} {len(definition.value)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _worker(f"library {name}", lambda: WordTable(library_encoder(definition.value)))
        whole = _worker(f"added {name}", lambda: added_encoder(definition.value)) if added else None
        part, local = TaskContext.get().partitionId(), 0
        for held in windows(batches, WINDOW_BYTES):
            ids_of_docs, done = pa.concat_arrays([b.column("doc_id") for b in held]), 0
            for rows, ids, ends in encode_window([b.column("text") for b in held], table):
                if whole and (found := whole(pa.concat_arrays([b.column("text") for b in held]).slice(done, rows))):
                    pieces = [found.get(i, ids[x:y]) for i, (x, y) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))]
                    ids, ends = np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
                counts = np.diff(ends)
                row = np.insert(ids, ends[1:], separator).astype("<u4")  # one separator after each document
                at = ends + np.arange(rows + 1)
                yield pa.record_batch([
                    pa.array(np.full(rows, part), pa.int32()), pa.array(local + at[:-1], pa.int64()),
                    ids_of_docs.slice(done, rows), pa.array(counts + 1, pa.int64()),
                    pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(row)]),
                ], names=["part", "local_start", "doc_id", "n_tokens", "ids"])
                local, done = local + int(at[-1]), done + rows

    return plain(docs).mapInArrow(run, "part int, local_start long, doc_id long, n_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, length: int = SEQUENCE_TOKENS, separator: int = SEPARATOR_ID, digests: bool = False, added: bool = True) -> DataFrame:
    """Records of pieces: doc_id, start, length, ids (or ids_crc32), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    first = stored(tokenized(docs, tokenizer_path, separator, added), "tokens")
    totals = sorted(first.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # one row per partition
    bases, total = [], 0
    for part, n in totals:
        bases.append((part, total))
        total += n
    placed = first.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part")
    placed = placed.select("doc_id", (F.col("base") + F.col("local_start")).alias("at"), "ids")
    what = "ids_crc32" if digests else "ids"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", what, "doc_tokens", "sequence_id", "offset")}
            for doc, at, ids in zip(b.column("doc_id").to_pylist(), b.column("at").to_pylist(), b.column("ids"), strict=True):
                view, done = memoryview(ids.as_buffer()), 0
                n = len(view) // 4
                while done < n:
                    sequence, offset = divmod(at + done, length)
                    size = min(n - done, length - offset)
                    piece = view[4 * done : 4 * (done + size)]
                    out["doc_id"].append(doc)
                    out["start"].append(done)
                    out["length"].append(size)
                    out[what].append(zlib.crc32(piece) if digests else piece.tobytes())
                    out["doc_tokens"].append(n)
                    out["sequence_id"].append(sequence)
                    out["offset"].append(offset)
                    done += size
            kind = pa.int64() if digests else pa.binary()
            yield pa.record_batch([pa.array(v, kind if k == what else pa.int64()) for k, v in out.items()], names=list(out))

    return placed.mapInArrow(cut, f"doc_id long, start long, length long, {what} {'long' if digests else 'binary'}, doc_tokens long, sequence_id long, offset long")
