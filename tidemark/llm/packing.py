"""Packing by concatenating and cutting.

Pass one tokenizes every document where it lies and stores its ids with its token offset inside its partition. The prefix sums
of the partitions' totals then give each document its place in one endless stream, which pass two cuts into fixed windows:
a piece is the part of a document within one window. Only the last sequence is padded.

A null text counts as empty and gives its end id alone. Order is that of the partitions and of the rows in them, written with
the ids, so the result doesn't change when a task runs again. Repeated rows are packed each; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, worker_state

LENGTH = 2048
END_ID = 1


class WholeTokenizer:
    """Ids of whole texts as little-endian 16-bit bytes (32-bit for vocabularies of more than 65,536 ids).

    A byte-level vocabulary whose ids are the ranks of its merges is searched by tiktoken, which gives the same ids in a fifth of the time;
    texts that its regular expressions can't read (runs of white space of some 100,000 characters) and all other vocabularies go
    through the tokenizers library itself. Special tokens in a text keep their ids, as in the library's plain call.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size() > 65_536
        with open(path, encoding="utf-8") as f:
            self.fast = _ranked(json.load(f))

    def encode(self, texts: list[str]) -> list[bytes]:
        kind, out = np.dtype("<u4" if self.wide else "<u2"), []
        for text in texts:
            ids = None
            if self.fast is not None:
                try:
                    ids = self.fast.encode_to_numpy(text, allowed_special="all")
                except ValueError:
                    pass
            if ids is None:
                ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
            out.append(ids.astype(kind).tobytes())
        return out


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself where it is printable, else the next letter from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _ranked(spec: dict):
    """A tiktoken encoding of the same ids, or None if the vocabulary is of another kind."""
    import tiktoken
    from public_tokenizers import PATTERN

    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if any(before.get(k) != v for k, v in plain.items()) or spec.get("normalizer") or spec.get("truncation") or spec.get("padding"):
        return None
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", [])):
        return None
    vocab, letters = {t: i for t, i in model["vocab"].items() if t not in added}, _byte_letters()
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if any(vocab.get(c, 256) > 255 for c in letters) or len(vocab) != 256 + len(merged) or any(vocab.get(t) != 256 + k for k, t in enumerate(merged)):
        return None
    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks={bytes(letters[c] for c in t): i for t, i in vocab.items()}, special_tokens=added)


def _tokenizer(path: str) -> WholeTokenizer:
    return worker_state(("packing", path), lambda: WholeTokenizer(path))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenised(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """part, start (tokens before it in its partition), doc_id, doc_tokens, ids (little-endian, end id included): pass one, written."""
    path = tokenizer or default_tokenizer()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, at = _tokenizer(path), TaskContext.get().partitionId(), 0
        width = 4 if tok.wide else 2
        end = end_id.to_bytes(width, "little")
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                ids = [x + end for x in tok.encode([t or "" for t in b.column(1).to_pylist()])]
                n = np.array([len(x) // width for x in ids], dtype=np.int64)
                start = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, dtype=np.int32)), pa.array(start), b.column(0), pa.array(n), pa.array(ids, pa.binary())], names=["part", "start", "doc_id", "doc_tokens", "ids"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(chosen.mapInArrow(encode, "part int, start long, doc_id long, doc_tokens long, ids binary"), "packing-ids")


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids: one row for each piece."""
    rows = tokenised(docs, tokenizer, end_id)
    totals = rows.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    # one row for each input partition: the only thing that is summed in one place
    base = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    placed = rows.join(F.broadcast(base), "part").select("doc_id", "doc_tokens", "ids", (F.col("base") + F.col("start")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, n, ids, at in zip(*(b.column(c).to_pylist() for c in range(4))):
                ids = np.frombuffer(ids, dtype="<u4" if len(ids) == 4 * n else "<u2").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    take = min(n - start, length - offset)
                    piece = ids[start : start + take].tobytes()
                    out.append((doc_id, start, take, zlib.crc32(piece), n, sequence, offset, piece))
                    start += take
            kinds = [pa.int64()] * 7 + [pa.binary()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.drop("ids")


QUERY = lambda spark, sf_dir: digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))
