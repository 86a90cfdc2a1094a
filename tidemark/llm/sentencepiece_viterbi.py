"""SentencePiece encoding by a streaming Viterbi search, and decoding.

Text is read character by character. For each of the last `longest` positions the search keeps one backpointer: the piece on the best path
to that position. Paths that still can grow are followed back; as soon as all of them pass one boundary, the ids before it are
committed and their state is dropped, so that the state is a window bounded by the longest piece, whatever the text's length.

A unigram model's best path has the largest sum of scores. A BPE model's path is the one its merges give: a piece may follow another only if
merging their joint text gives these two pieces again, which makes exactly one path valid at each position; ids equal those of the sentencepiece
library. Characters outside the vocabulary become byte pieces. No piece of a model whose pieces hold the space mark only in front
crosses a word, so its words are committed on their own and the ids of frequent words are kept in a bounded cache.

Null counts as empty; an empty text has no ids. Any text decodes to itself, but for the space mark U+2581 itself, which decodes to a space, as in the library. Rows are independent of each other.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CACHE_WORDS = 600_000
#: Characters up to which runs are searched many at once; longer ones go one by one, character by character. Both commit by the same rule.
ABREAST = 64
_models: dict[str, Vocabulary] = {}


def _is_bpe(proto: bytes) -> bool:
    """trainer_spec (field 2) model_type (field 3) of a model file: 2 is BPE, 1 (the default) unigram."""

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def varint() -> int:
            nonlocal at
            value = shift = 0
            while True:
                b = data[at]
                at += 1
                value |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return value

        while at < len(data):
            tag = varint()
            if tag & 7 == 0:
                yield tag >> 3, varint()
            else:
                n = {1: 8, 5: 4}.get(tag & 7) or varint()
                yield tag >> 3, data[at : at + n]
                at += n

    spec = next((v for k, v in fields(proto) if k == 2), b"")
    return next((v for k, v in fields(spec) if k == 3), 1) == 2


class Vocabulary:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str | None = None, pieces: dict[str, float] | None = None, bpe: bool = False) -> None:
        """From a model file; or, for tests, from pieces and scores (ids in the given order, bytes after them)."""
        if path:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            n = sp.get_piece_size()
            self.text = [sp.id_to_piece(i) for i in range(n)]
            normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
            self.score = {i: sp.get_score(i) for i in normal}
            self.bytes = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
            self.bpe = _is_bpe(sp.serialized_model_proto())
        else:
            self.text = [*(pieces or {}), *(f"<0x{b:02X}>" for b in range(256))]
            self.score = dict(enumerate((pieces or {}).values()))
            self.bytes = {b: len(pieces or {}) + b for b in range(256)}
            self.bpe = bpe
        self.id = {self.text[i]: i for i in self.score}
        self.longest = max(map(len, self.id), default=1)
        self.prefixes = {p[:k] for p in self.id for k in range(1, len(p) + 1)}
        self.by_word = not any(MARK in p.strip(MARK) or p.endswith(MARK) and p.strip(MARK) for p in self.id)
        self.least = min(self.score.values(), default=0.0) - 10
        self.cache: dict[str, bytes] = {}
        self.characters = {p for p in self.id if len(p) == 1}
        self.words: Words | None = None
        if self.bpe:
            # single characters merge before anything else; then by score
            order = sorted(self.id, key=lambda p: (len(p) > 1, -self.score[self.id[p]], self.id[p]))
            self.rank = {p: k for k, p in enumerate(order)}
            self.split: dict[str, tuple[str, str]] = {}
            self.merged: dict[tuple[str, str], str] = {}
            self.valid: dict[tuple[str, str], bool] = {}
            self.unreachable: set[str] = set()
            for p in order:
                if len(p) > 1:
                    parts = self._merge(p)
                    if len(parts) == 2:
                        self.split[p] = (parts[0], parts[1])
                        self.merged[parts[0], parts[1]] = p
                    else:
                        self.unreachable.add(p)

    def _merge(self, p: str) -> list[str]:
        """Merge the characters of p by rank, up to the last merge (which would give p itself)."""
        parts = list(p)
        while len(parts) > 2:
            best = min(((self.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank and a + b != p), default=None)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts if len(parts) == 2 and all(x in self.rank for x in parts) else []

    def compatible(self, left: str, right: str) -> bool:
        """Whether the merges of left + right end in these two pieces: unmerging from the seam, no merge across it may come first."""
        if left not in self.rank or right not in self.rank:
            return True
        key = (left, right)
        known = self.valid.get(key)
        if known is None:
            known = self._compatible(left, right)
            if len(self.valid) < 1_000_000:
                self.valid[key] = known
        return known

    def _compatible(self, a: str, b: str) -> bool:
        rank, limit = self.rank, 1 << 60
        while True:
            both = a + b
            if both in rank and both not in self.unreachable and (a, b) in self.merged and rank[both] < limit:
                return False
            if rank[a] > rank[b]:  # a was made later: undo it
                if len(a) == 1:
                    return True
                limit = rank[a]
                a = self.split[a][1]
            else:
                if len(b) == 1:
                    if len(a) == 1:
                        return True
                    limit = rank[a]
                    a = self.split[a][1]
                    continue
                limit = rank[b] + 1
                b = self.split[b][0]


def viterbi(v: Vocabulary, chars: Iterable[str], window: list[int] | None = None) -> Iterator[str]:
    """Pieces of a stream of characters (unknown characters as they are), each as soon as it is certain. window: gets the state's largest size."""
    # state by position since the last commit: text of the piece on the best path to it, and the path's score
    buffer: list[str] = []  # uncommitted characters
    piece: list[str | None] = [""]
    score: list[float] = [0.0]
    last = ""  # the last committed piece
    live: list[tuple[int, str]] = []  # (start, text so far) of pieces that may still grow
    for c in chars:
        live = [(s, t + c) for s, t in live if t + c in v.prefixes]
        if c in v.prefixes:
            live.append((len(buffer), c))
        buffer.append(c)
        at = len(buffer)
        best, best_score = None, float("-inf")
        for s, t in live:  # longest first
            if piece[s] is None or t not in v.id:
                continue
            if v.bpe:
                if t not in v.unreachable and v.compatible(piece[s] or last, t) if (piece[s] or last) else t not in v.unreachable:
                    best, best_score = t, 0.0
                    break
            elif score[s] + v.score[v.id[t]] > best_score:
                best, best_score = t, score[s] + v.score[v.id[t]]
        if c not in v.id and piece[at - 1] is not None and (not v.bpe or best is None):
            if score[at - 1] + v.least > best_score:
                best, best_score = c, score[at - 1] + v.least
        piece.append(best)
        score.append(best_score)
        # where the paths that can go on have met: from the end, and from every piece that may still grow
        ends = {s for s, _ in live} | {at}
        ends = {e for e in ends if piece[e] is not None}
        if at >= 2 * v.longest or len(ends) == 1:
            while len(ends) > 1:
                e = max(ends)
                if e == 0:
                    break
                ends.discard(e)
                ends.add(e - len(piece[e]))
            meet = ends.pop()
            if meet > 0:
                done, e = [], meet
                while e > 0:
                    done.append(piece[e])
                    e -= len(piece[e])
                yield from reversed(done)
                last = done[0]
                del buffer[:meet]
                piece, score = ["", *piece[meet + 1 :]], score[meet:]
                live = [(s - meet, t) for s, t in live]
        if window is not None:
            window[0] = max(window[0], len(buffer))
    done, e = [], len(buffer)
    while e > 0:
        done.append(piece[e])
        e -= len(piece[e])
    yield from reversed(done)


def _ids(v: Vocabulary, pieces: Iterable[str]) -> list[int]:
    out: list[int] = []
    for p in pieces:
        i = v.id.get(p)
        if i is None:
            out += [v.bytes[b] for b in p.encode()]
        else:
            out.append(i)
    return out


_HASH = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The same search for many short texts of a BPE model at once, a column of characters at a time, in numpy. Pieces go by their rank of merging."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.n = np.int64(len(v.rank))
        self.left, self.right = (np.full(len(v.rank), -1, dtype=np.int64) for _ in range(2))
        for p, (a, b) in v.split.items():
            self.left[v.rank[p]], self.right[v.rank[p]] = v.rank[a], v.rank[b]
        keys = np.array([v.rank[a] * int(self.n) + v.rank[b] for a, b in v.merged], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.array([v.rank[p] for p in v.merged.values()], dtype=np.int64)[order]
        self.id = np.array([v.id[p] for p in sorted(v.rank, key=v.rank.__getitem__)], dtype="<u4")
        prefixes = sorted(v.prefixes)
        hashes = np.array([self._hash(p) for p in prefixes], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two prefixes share a hash")
        self.piece = np.array([v.rank[p] if p in v.rank and p not in v.unreachable else -1 for p in prefixes], dtype=np.int64)[order]

    @staticmethod
    def _hash(p: str) -> int:
        h = 0
        for c in p:
            h = (h + ord(c)) * int(_HASH) & (1 << 64) - 1
            h ^= h >> 29
        return h

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Vocabulary.compatible for arrays of ranks."""
        out = np.ones(len(a), dtype=bool)
        live, limit = np.arange(len(a)), np.full(len(a), 1 << 60, dtype=np.int64)
        while len(live):
            key = a * self.n + b
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            bad = (self.keys[at] == key) & (self.made[at] < limit)
            out[live[bad]] = False
            later = a > b
            go = ~bad & np.where(later, self.left[a] >= 0, self.left[b] >= 0)
            live, a, b, later = live[go], a[go], b[go], later[go]
            limit = np.where(later, a, b + 1)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return out

    def encode(self, words: list[str], commits: list[int] | None = None) -> list[bytes]:
        """Ids as bytes. Words must be of characters of the vocabulary. commits: gets the longest stretch between two commits.

        All pieces that start at one place are looked at before those that start at the next. Every `longest` places the pieces that end further on are
        followed back in each word; as soon as all of them pass one boundary, the ids before it are committed.
        """
        n = np.array([len(w) for w in words], dtype=np.int64)
        width = int(n.max())
        code = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), width).astype(np.uint64)
        last = np.full((len(words), width + 1), -1, dtype=np.int64)
        start = np.zeros((len(words), width + 1), dtype=np.int64)
        base = np.zeros(len(words), dtype=np.int64)  # up to where ids are committed
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # word, place of the piece's end, piece

        def commit(rows: np.ndarray, e: np.ndarray) -> None:
            if commits is not None:
                commits.append(int((e - base[rows]).max(initial=0)))
            ahead, lower = e.copy(), base[rows]
            base[rows] = e
            while len(rows):
                done.append((rows, ahead, last[rows, ahead]))
                ahead = start[rows, ahead]
                more = ahead > lower
                rows, ahead, lower = rows[more], ahead[more], lower[more]

        for s in range(width):
            rows = np.flatnonzero(n > s)
            h = np.zeros(len(rows), dtype=np.uint64)
            for e in range(s + 1, min(width, s + self.v.longest) + 1):
                inside = n[rows] >= e
                rows, h = rows[inside], h[inside]
                if not len(rows):
                    break
                h = (h + code[rows, e - 1]) * _HASH
                h ^= h >> np.uint64(29)
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                known = self.hashes[at] == h
                rows, h, piece = rows[known], h[known], self.piece[at[known]]
                ends = np.flatnonzero(piece >= 0)
                if s and len(ends):
                    pair, where = np.unique(last[rows[ends], s] * self.n + piece[ends], return_inverse=True)
                    ends = ends[self.compatible(pair // self.n, pair % self.n)[where]]
                last[rows[ends], e], start[rows[ends], e] = piece[ends], s
            if (s + 1) % self.v.longest == 0 and s + 1 < width:
                rows = np.flatnonzero(n > s + 1)
                further = np.arange(s + 1, min(width, s + self.v.longest) + 1)
                paths = np.where(last[rows][:, further] >= 0, further, -1)
                while len(rows):
                    top = paths.max(axis=1)
                    apart = ((paths >= 0) & (paths < top[:, None])).any(axis=1)
                    if not apart.any():
                        break
                    back = np.where(apart, start[rows, top], top)
                    paths = np.where((paths == top[:, None]) & apart[:, None], back[:, None], paths)
                met = top > base[rows] if len(rows) else np.zeros(0, dtype=bool)
                commit(rows[met], top[met] if len(rows) else rows)
        commit(np.arange(len(words)), n.copy())
        row, place, piece = (np.concatenate(c) for c in zip(*done))
        order = np.lexsort((place, row))
        raw = self.id[piece[order]].tobytes()
        end = (4 * np.cumsum(np.bincount(row, minlength=len(words)))).tolist()
        return [raw[a:b] for a, b in zip([0, *end], end)]


_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _cut(text: str) -> list[str]:
    """Words without the mark in front of them; where spaces repeat or the text holds the mark, runs of marks with what follows, marks kept."""
    if not text:
        return []
    if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [w[1:] if w.count(MARK) == 1 else MARK + w for w in _WORD.findall(MARK + text.replace(" ", MARK))]


def _whole(word: str) -> str:
    """The marked text that an item of _cut stands for."""
    return word[1:] if word.startswith(MARK) else MARK + word


def _known_runs(v: Vocabulary, text: str) -> list[str]:
    """text cut around the characters outside the vocabulary, with which no piece merges."""
    if v.characters.issuperset(text):
        return [text]
    out = [""]
    for c in text:
        if c in v.characters:
            out[-1] += c
        else:
            out += [c, ""]
    return [x for x in out if x]


def encode_all(v: Vocabulary, texts: list[str]) -> list[bytes]:
    """Ids of each text as little-endian 32-bit numbers."""
    if not v.by_word:
        return [np.array(_ids(v, viterbi(v, MARK + t.replace(" ", MARK))) if t else [], dtype="<u4").tobytes() for t in texts]
    cut = [_cut(t) for t in texts]
    cache = v.cache
    new = {w: _known_runs(v, _whole(w)) for w in {w for ws in cut for w in ws if w not in cache}}
    runs: dict[str, bytes] = {}
    short = []
    for r in {r for rs in new.values() for r in rs}:
        if v.bpe and len(r) <= ABREAST and r[0] in v.characters:
            short.append(r)  # many short streams abreast; the same search
        else:
            runs[r] = np.array(_ids(v, viterbi(v, r)), dtype="<u4").tobytes()
    if short:
        if v.words is None:
            v.words = Words(v)
        short.sort(key=len)
        for lo in range(0, len(short), 8192):
            runs.update(zip(short[lo : lo + 8192], v.words.encode(short[lo : lo + 8192])))
    extra = {w: runs[rs[0]] if len(rs) == 1 else b"".join(map(runs.__getitem__, rs)) for w, rs in new.items()}
    if len(cache) + len(extra) <= CACHE_WORDS:
        cache.update(extra)
        extra = {}
    get = cache.__getitem__ if not extra else lambda w: cache[w] if w in cache else extra[w]
    return [b"".join(map(get, ws)) for ws in cut]


def encode(v: Vocabulary, text: str) -> bytes:
    return encode_all(v, [text])[0]


def decode(v: Vocabulary, ids: list[int]) -> str:
    if not hasattr(v, "raw"):
        back = {i: bytes([b]) for b, i in v.bytes.items()}
        v.raw = [back.get(i) or t.replace(MARK, " ").encode() for i, t in enumerate(v.text)]
    return b"".join(map(v.raw.__getitem__, ids)).decode()[1:]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> Vocabulary:
    if path not in _models:
        _models[path] = Vocabulary(path)
    return _models[path]


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text, ids (little-endian 32-bit): a row for each row of docs."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(encode_all(v, [t or "" for t in b.column(1).to_pylist()]), pa.binary())], names=["doc_id", "text", "ids"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, text string, ids binary")


def roundtrip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256, exact: ids of every whole text, and whether they decode to it."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                rows = []
                texts = b.column(1).to_pylist()
                for doc_id, text, raw in zip(b.column(0).to_pylist(), texts, encode_all(v, [t or "" for t in texts])):
                    back = decode(v, np.frombuffer(raw, "<u4").tolist())
                    rows.append((doc_id, len(raw) // 4, zlib.crc32(raw), hashlib.sha256(back.encode()).hexdigest(), back == (text or "")))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "exact"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, exact boolean")


QUERY = lambda spark, sf_dir: roundtrip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
