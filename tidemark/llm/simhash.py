"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are collapsed to distinct values first, so groups of copies cost one row. The 64 bits are cut into radius + m bands; two fingerprints
within the radius agree on m bands at least, so each choice of m bands is one exact table of buckets. m grows with the number of fingerprints, so that
buckets stay small. Inside a bucket the fingerprints are stored as 64 vertical bit planes; the planes shifted by d lanes are xor-ed with
themselves and added up by carry-save adders, giving 64 distances a word; words all of whose distances exceed the radius are abandoned.
A bucket gives the edges of a spanning forest, never its pairs. A bucket larger than CELL is cut into chunks whose pairs
are compared in tasks of their own, so no bucket size is dropped or gathered in one task.

Null and empty texts and texts without words have fingerprint zero, which links like any other. Texts of one to three words hash
their whole sequence. Rows that share a doc_id are separate rows. A null doc_id never becomes a component's id unless all are null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_CLASS, connected_components, forget, materialise
from .substring_dedup import _B1, Ranges, word_hashes

RADIUS = 4
SHINGLE = 4
#: Rows of a bucket that one task compares with each other at most (twice as many in a cell of two chunks).
CELL = 4096
#: Rows of a bucket on average beyond which more and wider keys are used.
CROWD = 16
#: Near copies in the pipeline: words of a shingle, and Jaccard similarity of the sets in percent. A bit of the fingerprints of two sets with
#: similarity 0.8 differs with a probability of 0.151, that is 9.7 of 64 bits, with a deviation of 2.9: WIDE is 3.6 deviations above.
STAGE_SHINGLE, PERCENT, WIDE = 5, 80, 20
#: Rows whose shingles are counted, and how often a common one occurs there. The sample decides the cost, never the result.
SAMPLE, COMMON, MOST_COMMON = 4096, 4, 50_000
#: Shingles by which rows meet beyond which they are shuffled in so many slices one after the other, so that the disk holds one slice.
SLICED, SLICES = 4_000_000, 4
#: Rows and shingles of a group of candidates beyond which it is cut into chunks, and words of the matrix of a group's shared shingles.
GROUP, SHINGLES, MATRIX_WORDS = 2048, 4_000_000, 1 << 24
_BITS = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned number: a bit is 1 if it is set in more than half of the shingles' hashes."""
    from xxhash import xxh64_intdigest

    words = re.findall(WORD_CLASS, (text or "").encode().translate(_LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: -shingle].tolist()]
    hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], dtype=">u8")
    n = len(hashes)
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(_BITS[2 * counts > n].sum(dtype=np.uint64)) if (2 * counts > n).any() else 0


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed long of the same bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _planes(fps: np.ndarray) -> np.ndarray:
    """64 rows: bit i of the fingerprints of 64 lanes in one word each, lowest lane in the lowest bit. As many empty words follow."""
    lanes = -len(fps) % 64
    padded = np.concatenate([fps, np.zeros(lanes, dtype=np.uint64)])
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    words = np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)
    return np.concatenate([words, np.zeros((64, words.shape[1] + 2), dtype=np.uint64)], axis=1)


def _within(planes: np.ndarray, d: int, n_words: int, radius: int) -> np.ndarray:
    """A word for each 64 lanes: a bit is set where lanes i and i + d differ in at most radius bits.

    After every 16 planes the words all of whose distances exceed the radius are abandoned.
    """
    width = max(2, (radius + 1).bit_length())
    count = [np.zeros(n_words, dtype=np.uint64) for _ in range(width)]
    over = np.zeros(n_words, dtype=np.uint64)
    whole, part = divmod(d, 64)
    at: slice | np.ndarray = slice(0, n_words)  # the words that are left
    low, high = slice(whole, whole + n_words), slice(whole + 1, whole + 1 + n_words)

    def beyond() -> np.ndarray:
        more, equal = over.copy(), ~over
        for k in reversed(range(width)):
            if radius >> k & 1:
                equal &= count[k]
            else:
                more |= equal & count[k]
                equal &= ~count[k]
        return more

    def differ(plane: np.ndarray) -> np.ndarray:
        if not part:
            return plane[at] ^ plane[low]
        return plane[at] ^ (plane[low] >> np.uint64(part) | plane[high] << np.uint64(64 - part))

    ones = ~np.uint64(0)
    for k in range(0, 64, 2):
        a, b = differ(planes[k]), differ(planes[k + 1])
        half = count[0] ^ a  # carry-save: three words in, sum and carry out
        carry = (count[0] & a) | (b & half)
        count[0] = half ^ b
        for j in range(1, width):
            count[j], carry = count[j] ^ carry, count[j] & carry
        over |= carry
        if k % 16 == 14 and k < 62:
            left = np.flatnonzero(beyond() != ones)
            if len(left) < len(over):
                at = np.arange(n_words)[at][left]
                if not len(at):
                    break
                low, high = at + whole, at + whole + 1
                count, over = [c[left] for c in count], over[left]
    out = np.zeros(n_words, dtype=np.uint64)
    if len(over):
        out[at] = ~beyond() if len(out[at]) else 0
    return out


def linked(fps: np.ndarray, groups: np.ndarray, radius: int = RADIUS, accept=None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that make a spanning forest of the links inside each group: of rows that differ in at most radius bits, where accept(x, y) holds. groups:
    sorted ids. Pairs are looked at, and asked about, only while they are apart; a group is left as soon as it is one piece.
    """
    fps = fps.astype(np.uint64)
    parent = np.arange(len(fps))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    _, first, inverse, size = np.unique(groups, return_index=True, return_inverse=True, return_counts=True)
    pieces = size.copy()
    d = 1
    while True:
        keep = (size > d) & (pieces > 1)
        if not keep.any():
            break
        own_first, own_size, own_group = first[keep], size[keep], np.flatnonzero(keep)
        order = np.argsort(-own_size, kind="stable")  # lanes of large groups first: later shifts need a prefix only
        own_first, own_size, own_group = own_first[order], own_size[order], own_group[order]
        total = int(own_size.sum())
        lanes = np.arange(total) + np.repeat(own_first - (np.cumsum(own_size) - own_size), own_size)
        ends = np.repeat(np.cumsum(own_size), own_size)
        upto = np.cumsum(own_size)
        planes = _planes(fps[lanes])
        while d < own_size[0]:
            longer = int(np.searchsorted(-own_size, -d, side="left"))  # groups of more than d rows
            live = int(upto[longer - 1])
            hit = np.flatnonzero(np.unpackbits(_within(planes, d, -(-live // 64), radius).view(np.uint8), bitorder="little"))
            hit = hit[hit < live]
            hit = hit[hit + d < ends[hit]]
            x, y = lanes[hit], lanes[hit + d]
            d += 1
            apart = parent[x] != parent[y]
            x, y = x[apart], y[apart]
            if accept is not None and len(x):
                good = accept(x, y)
                x, y = x[good], y[good]
            if not len(x):
                continue
            joins = []
            for i, j in zip(x.tolist(), y.tolist()):
                u, v = i, j
                while parent[u] != u:
                    u = parent[u]
                while parent[v] != v:
                    v = parent[v]
                if u != v:
                    parent[max(u, v)] = min(u, v)
                    joins.append((i, j))
                    pieces[inverse[i]] -= 1
            while (parent[parent] != parent).any():
                parent = parent[parent]
            found.append(tuple(np.array(joins, dtype=np.int64).reshape(-1, 2).T))
            if 2 * own_size[pieces[own_group] > 1].sum() < live:
                break  # most lanes are of groups that are one piece: pack the others anew
        else:
            break
    if not found:
        return np.array([], dtype=np.int64), np.array([], dtype=np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def forest(fps: np.ndarray, groups: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints that make a spanning forest of the links inside each group. groups: sorted ids."""
    x, y = linked(fps, groups, radius)
    return fps.astype(np.uint64)[x], fps.astype(np.uint64)[y]


def bands(radius: int, rows: int = 0) -> tuple[list[int], int]:
    """Bounds of the bands, and how many of them agree in full in each pair within radius: as few as leave CROWD rows in a bucket on average."""
    for n in range(radius + 2, 64):
        if rows <= CROWD << (64 // n * (n - radius)) or n - radius >= 5:
            break
    return [round(64 * k / n) for k in range(n + 1)], n - radius


def _cells(rows: DataFrame, cell: int, name: str) -> DataFrame:
    """rows: key, node, more. With i and j: rows of a key in cells of two chunks of about cell rows; each two rows of a key meet in one cell."""
    sizes = materialise(rows.groupBy("key").count().where(F.col("count") > cell), name)
    if sizes.isEmpty():
        return rows.withColumns({"i": F.lit(0), "j": F.lit(0)})
    chunks = rows.join(sizes, "key", "left").withColumn("chunks", F.ceil(F.coalesce("count", F.lit(1)) / cell).cast("int")).drop("count")
    own = chunks.withColumn("c", F.pmod(F.xxhash64(F.lit("chunk"), "node"), F.col("chunks")).cast("int"))
    other = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return other.withColumns({"i": F.least("c", "o"), "j": F.greatest("c", "o")}).drop("c", "o", "chunks")


def _by_cell(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """work(columns, groups) on stretches of whole cells. batches: key, i, j, more; sorted by them."""
    held: list[list[np.ndarray]] = []
    n = 0

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, n
        if not held:
            return
        cols = [np.concatenate(c) for c in zip(*held)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
        end = len(cols[0]) if last else (int(change[-1]) if len(change) else 0)
        groups = np.zeros(len(cols[0]), dtype=np.int64)
        groups[change] = 1
        a, b = work([c[:end] for c in cols[3:]], np.cumsum(groups)[:end])
        held = [[c[end:] for c in cols]] if end < len(cols[0]) else []
        n = len(cols[0]) - end
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        n += batch.num_rows
        if n >= 1 << 17:
            yield from flush(False)
    yield from flush(True)


def links(distinct: DataFrame, rows: int = 0, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """distinct: fp; rows: about how many. Edges (a, b) whose components are those of all pairs within radius."""
    at, agree = bands(radius, rows)
    keys = []
    for t, chosen in enumerate(combinations(range(len(at) - 1), agree)):
        cut = [F.shiftrightunsigned("fp", at[k]).bitwiseAND(F.lit((1 << (at[k + 1] - at[k])) - 1)) for k in chosen]
        keys.append(F.xxhash64(F.lit(t), *cut))  # equal hashes of unequal bands only add comparisons
    cells = _cells(distinct.select(F.col("fp").alias("node"), F.explode(F.array(*keys)).alias("key")), cell, "simhash-large")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _by_cell(batches, lambda cols, groups: forest(cols[0].view(np.uint64), groups, radius))

    dealt = cells.select("key", "i", "j", "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, cell: int = CELL) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id of the component): one row for each row of docs."""
    own = materialise(fingerprints(docs, shingle), "simhash-fps")
    classes = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-classes")
    nodes = connected_components(links(classes.select("fp"), classes.count(), radius, cell))
    # written, so that a component of any size is split in the joins
    labelled = materialise(classes.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp")), "simhash-labelled")
    least = materialise(labelled.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash-least")
    by_fp = materialise(labelled.select("fp", "root").join(least, "root").select("fp", "component_id"), "simhash-components")
    return own.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str | None, shingle: int = STAGE_SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; of its whole sequence if it is shorter, and one common value without words."""
    words, _ = word_hashes((text or "").encode().translate(_LOWER))
    if not len(words):
        return np.zeros(1, dtype=np.int64)
    first = np.arange(max(1, len(words) - shingle + 1))
    return np.unique(Ranges(words, _B1).of(first, np.minimum(first + shingle, len(words))).view(np.int64))


def _majority(hashes: np.ndarray) -> int:
    """The SimHash of a set of hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = _BITS[2 * counts > len(hashes)]
    return int(bits.sum(dtype=np.uint64)) if len(bits) else 0


def far(percent: int) -> int:
    """In how many of 128 more bits of SimHash candidates may differ.

    Of rows that meet, one unrelated pair in 550 is within WIDE by chance: enough to chain most of a large table together. Sets of the least similarity differ
    in 128 * p of these bits, with p by their angle; 7 deviations are added. At 80 percent that is 48, and of unrelated pairs one in 330 is left.
    """
    p = np.arccos(2 * percent / (100 + percent)) / np.pi
    return int(np.ceil(128 * p + 7 * np.sqrt(128 * p * (1 - p))))


def _more(hashes: np.ndarray, n: int) -> int:
    """The SimHash of a set of hashes by 64 other bits, for each n others."""
    x = hashes.view(np.uint64) + np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return _majority((x ^ (x >> np.uint64(31))).view(np.int64))


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """rows: node, text, more. node, more, fp, own: the SimHash and the shingle set of each."""
    more = [f for f in rows.schema.fields if f.name not in ("node", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                own = [shingle_set(t.as_py(), shingle) for t in part.column(1)]
                fps = np.array([_majority(x) for x in own], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(fps), pa.array(own, pa.list_(pa.int64()))], names=["node", *[f.name for f in more], "fp", "own"])

    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in more)
    return rows.select("node", "text", *[f.name for f in more]).mapInArrow(run, f"node long{kinds}, fp long, own array<long>")


def _sketches(rows: DataFrame, common: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """rows: row, text. row, fp, w1, w2 (128 more bits of SimHash), n (size of the shingle set), s1, s2 (digest of the set), prefix.

    Of two sets of n shingles whose similarity is percent / 100 at least, both hold one of the first n - ceil(n * percent / 100) + 1, in any order that all
    texts share. Here common ones come last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                fps, sizes, digests, prefixes = ([], [], []), [], [], []
                for t in part.column(1):
                    own = shingle_set(t.as_py(), shingle)
                    n = len(own)
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1) if len(common) else None
                    late = common[at] == own if len(common) else np.zeros(n, dtype=bool)
                    for k, words in enumerate(fps):
                        words.append(_more(own, k) if k else _majority(own))
                    sizes.append(n)
                    digests.append(xxh3_128_digest(own.tobytes()))
                    prefixes.append(np.concatenate([own[~late], own[late]])[: n + (-n * percent // 100) + 1])
                both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(np.array(words, dtype=np.uint64).view(np.int64)) for words in fps], pa.array(sizes, pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(prefixes, pa.list_(pa.int64()))], names=["row", "fp", "w1", "w2", "n", "s1", "s2", "prefix"])

    return rows.mapInArrow(run, "row long, fp long, w1 long, w2 long, n int, s1 long, s2 long, prefix array<long>")


def _met(known: DataFrame, marks: DataFrame, percent: int, radius: int, cell: int) -> DataFrame:
    """known: key, node; marks: node, fp, w1, w2, n. a, b: pairs that link the rows of each key as far as fingerprints and sizes allow the similarity; a
    forest, never all pairs."""

    most = far(percent)

    def work(cols: list[np.ndarray], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node, fp, w1, w2, n = *cols[:4], cols[4].astype(np.int64)

        def accept(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            differ = sum(np.bitwise_count((w[x] ^ w[y]).view(np.uint64)).astype(np.int64) for w in (w1, w2))
            return (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (differ <= most)

        x, y = linked(fp.view(np.uint64), groups, radius, accept)
        return np.minimum(node[x], node[y]), np.maximum(node[x], node[y])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _by_cell(batches, work)

    cells = _cells(known, cell, "near-large").join(marks, "node").select("key", "i", "j", "node", "fp", "w1", "w2", "n")
    dealt = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def _common(sets: list[np.ndarray]):
    """f(x, y): the number of shingles that each pair of rows has in common. Shingles of one row only are left out; the others are bits of a row."""
    sizes = np.array([len(x) for x in sets])
    kinds, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    width = -(-int(shared.sum()) // 64)
    if not width or len(sets) * width > MATRIX_WORDS:
        return lambda x, y: np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(x.tolist(), y.tolist())], dtype=np.int64)
    place = np.cumsum(shared) - 1
    bits = np.zeros((len(sets), width), dtype=np.uint64)
    row, own = np.repeat(np.arange(len(sets)), sizes)[shared[where]], place[where[shared[where]]]
    word = row * width + own // 64
    order = np.argsort(word, kind="stable")
    word, bit = word[order], np.uint64(1) << (own[order] % 64).astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    bits.ravel()[word[first]] = np.bitwise_or.reduceat(bit, first)

    def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        step = max(1, (1 << 20) // width)
        return np.concatenate([np.bitwise_count(bits[x[lo : lo + step]] & bits[y[lo : lo + step]]).sum(axis=1, dtype=np.int64) for lo in range(0, len(x), step)])

    return common


def verified(fps: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT, radius: int = WIDE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that make a spanning forest of the true links: fingerprints within radius, similarity of the sets of percent / 100 at least."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    common = _common(sets)

    def accept(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = 100 * np.minimum(sizes[x], sizes[y]) >= percent * np.maximum(sizes[x], sizes[y])
        x, y = x[out], y[out]
        if len(x):
            out[out] = (100 + percent) * common(x, y) >= percent * (sizes[x] + sizes[y])  # 100 * common >= percent * union
        return out

    return linked(fps, np.zeros(len(fps), dtype=np.int64), radius, accept)


def _true_links(rows: DataFrame, percent: int, radius: int) -> DataFrame:
    """rows: node, component, fp, own; written. a, b: a spanning forest of the true links inside each component.

    A component of more than GROUP rows or SHINGLES shingles is cut into chunks, whose pairs are compared in tasks of their own.
    """
    chunks = F.ceil(F.greatest(F.col("count") / GROUP, F.col("total") / SHINGLES)).cast("int")
    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("count"), F.sum(F.size("own")).alias("total")).select("component", chunks.alias("chunks"))
    sizes = materialise(sizes.where("chunks > 1"), "near-sizes")
    own = rows.join(sizes, "component", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = own.withColumn("c", F.pmod(F.xxhash64(F.lit("chunk"), "node"), F.col("chunks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = own.select("component", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "node", "fp", "own")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, fps, sets = None, [], [], []

        def links_of() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                x, y = verified(np.array(fps, dtype=np.int64).view(np.uint64), sets, percent, radius)
                if len(x):
                    own = np.array(nodes, dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(own[x], own[y])), pa.array(np.maximum(own[x], own[y]))], names=["a", "b"])

        for b in batches:
            for *of, node, fp, one in zip(*(b.column(c).to_pylist() for c in range(5)), b.column(5)):
                if of != key:
                    yield from links_of()
                    key, nodes, fps, sets = of, [], [], []
                nodes.append(node)
                fps.append(fp)
                sets.append(one.values.to_numpy())
        yield from links_of()

    return cells.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node").mapInArrow(check, "a long, b long")


def similar(rows: DataFrame, percent: int = PERCENT, shingle: int = STAGE_SHINGLE, radius: int = WIDE, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """rows: row, text; written. (row, node): the first row with the same shingle set (null, empty and wordless texts share the empty one); and (node, component) of
    the nodes with links.

    Links are pairs of sets with a Jaccard similarity of percent / 100 at least, whose fingerprints differ in at most radius bits. Rows meet by the
    shingles of which similar sets share one; bit-sliced comparison links them by forests of pairs within the radius, and within far() of 128 more bits. The
    components of these hold every link (7 deviations leave out none that counts: tests), and hardly any other pair. Each row then goes to its component once, with its set, where bit-sliced comparison gives the pairs that are still apart
    and the sets decide. No step gives a row for each pair of a group.
    """
    every = max(1, rows.count() // SAMPLE)
    some = _sets(rows.where(F.pmod(F.xxhash64("row"), F.lit(every)) == 0).select(F.col("row").alias("node"), "text"), shingle).select(F.explode("own").alias("key"))
    common = some.groupBy("key").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "key").limit(MOST_COMMON)
    sketches = materialise(_sketches(rows, np.sort(common.select("key").toArrow()["key"].to_numpy().astype(np.int64)), shingle, percent), "near-sketches")
    firsts = materialise(sketches.groupBy("s1", "s2").agg(F.min("row").alias("node")), "near-firsts")
    members = materialise(sketches.select("row", "s1", "s2").join(firsts, ["s1", "s2"]).select("row", "node"), "near-members")
    own = sketches.join(firsts.select(F.col("node").alias("row")), "row", "left_semi")
    marks = materialise(own.select(F.col("row").alias("node"), "fp", "w1", "w2", "n"), "near-marks")
    prefixes = materialise(own.select(F.col("row").alias("node"), "prefix"), "near-prefixes")
    forget(sketches, firsts)
    slices = 1 if (prefixes.agg(F.sum(F.size("prefix"))).first()[0] or 0) <= SLICED else SLICES
    found = []
    for k in range(slices):
        keys = prefixes.select(F.explode("prefix").alias("key"), "node").where(F.pmod("key", F.lit(slices)) == k)
        shared = materialise(keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"), "near-shared")
        known = materialise(keys.join(shared, "key", "left_semi"), "near-known")
        forget(shared)
        found.append(materialise(_met(known, marks, percent, radius, cell), "near-met"))
        forget(known)
    candidates = materialise(reduce(DataFrame.unionByName, found).distinct(), "near-candidates")
    forget(prefixes, marks, *found)
    groups = connected_components(candidates)
    texts = rows.select(F.col("row").alias("node"), "text").join(groups, "node").select("node", "text", "component")
    sets = materialise(_sets(texts, shingle), "near-sets")
    labels = connected_components(materialise(_true_links(sets, percent, radius), "near-links"))
    forget(sets, candidates)
    return members, labels


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = STAGE_SHINGLE, radius: int = WIDE) -> DataFrame:
    """One row of docs for each group of near copies, all columns unchanged: that of the smallest doc_id, nulls last.

    A group is a component of the links of similar(). Null, empty and wordless texts have the same (empty) set and are one group; texts of fewer words than a shingle are
    one shingle. Rows that repeat, ids included, are copies: one stays. An empty table gives an empty result. Extra columns may have any names.
    """
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    own = materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*quoted).alias("doc")), "near-rows")
    text = F.col("doc.text").cast("string")
    members, labels = similar(own.select("row", text.alias("text")), percent, shingle, radius)
    grouped = members.join(labels, "node", "left").select("row", F.coalesce("component", "node").alias("group"))
    grouped = materialise(own.select("row", F.col("doc.doc_id").alias("doc_id"), F.xxhash64(text).alias("hash")).join(grouped, "row"), "near-grouped")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash", "row")).getField("row")
    keep = materialise(grouped.groupBy("group").agg(first.alias("row")).select("row"), "near-keep")
    return own.join(keep, "row", "left_semi").select("doc.*")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERY = lambda spark, sf_dir: digest(near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")))
