"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersection.

Documents of equal shingle sets form one class; classes are what is joined.

Tiles. Sizes fall into bands whose ends differ by the factor of the threshold, so a class
links only within its band or with the next. For sets of a tile (a band and the next) the
threshold bounds how many shingles can differ, say k. A seeded hash deals the shingles to
m > k parts; a linked pair then agrees on all the shingles of at least m - k parts. So a class
sends, for each tile, one key per part: the hash of what the part holds. Classes that share no
key cannot link. Parts that are empty say nothing; a class with m - k empty parts or more deals
its shingles anew with the next seed as well (its partner, equally empty, does the same).
Common shingles are no trouble, since a key covers all that a part holds.

Keys travel sorted and packed, from one pass over the texts that also names the sets. Classes of
one pack that share a key are linked to the least of them there, which alone is sent, so a key
that a third of all classes share reaches its bucket once from each pack. Buckets link the classes
that share a key likewise; linked classes, also through others, form a group.

Such a group grows with the table where texts have lines in common, so its sets are not what meets in
it, but sketches, a few bits a shingle, from the same pass over the texts: a bit says whether an odd number of
shingles falls on it, so two sets differ in as many shingles as their sketches in bits, or more. Classes
that may link by that, also through others, form a candidate group; the others go no further.

A group's classes meet in tiles of one band and the next; a large tile is cut to chunks, and each pair
of chunks is a task of its own. Tasks on sets compare them block by block. A task folds each set to a bitmap signature; the bits that two signatures share
bound the overlap from above, and all pairs that may reach the threshold are intersected. Each
pair meets in one task; a task returns how many links each class has in it, and of the links a
spanning set, so its rows grow with the classes and not with the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemill.llm.common import WordHashes, held, mixed, packed_sorted, rolled, row_key, unpacked_sorted
from tidemill.llm.components import components
from tidemill.session import forget, ship, table

#: Text bytes whose keys are packed together, and keys that a bucket holds on average.
PACK_BYTES = 8_000_000
BUCKET_KEYS = 500_000
#: Bits of a key that count within its bucket; keys that agree in them by chance only cost a comparison.
KEY_BITS = 40
SEEDS = 8
BITS_PER_SHINGLE = 8
#: Shingles that a block of a tile holds, which is compared at once, and blocks of a chunk; chunks
#: are what is shuffled, to each chunk of their tile, and stay packed until their block's turn.
BLOCK_SHINGLES, CHUNK_BLOCKS = 1_000_000, 8
#: Bytes and rows of a chunk of sketches.
SKETCH_BYTES, SKETCH_ROWS = 8_000_000, 131_072


def shingles(text: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words of a lower-cased text."""
    words = hashes.of(text.lower().split())  # bytes: A-Z only, ASCII white space only
    if not len(words):
        return words
    return np.unique(rolled(words, min(width, len(words))))


def set_id(shingle_set: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingle_set.tobytes(), digest_size=8).digest(), "little", signed=True)


class Bands:
    """Sizes by band, and the parts of each tile, for links of Jaccard percent / 100 or more."""

    def __init__(self, percent: int):
        self.percent = percent
        self.starts = [1]

    def _reach(self, start: int) -> int:
        """The first size that no set of size ``start`` links with."""
        return start * 100 // self.percent + 1

    def of(self, size: int) -> int:
        while self.starts[-1] <= size:
            self.starts.append(self._reach(self.starts[-1]))
        return int(np.searchsorted(self.starts, size, side="right")) - 1

    def parts(self, band: int) -> tuple[int, int]:
        """(m, k): a linked pair whose smaller set is in ``band`` differs in k shingles at most."""
        self.of(self.starts[-1]) if band + 1 >= len(self.starts) else None
        small = self.starts[band + 1] - 1
        large = small * 100 // self.percent
        k = (small + large) * (100 - self.percent) // (100 + self.percent)
        return k + 1 + (k + 1) // 8, k

    def bits(self, band: int) -> int:
        """Bits of a sketch in ``band``: a power of two, and one a shingle or more."""
        self.of(self.starts[-1]) if band + 1 >= len(self.starts) else None
        return max(64, 1 << (self.starts[band + 1] - 2).bit_length())


def sketch(shingle_set: np.ndarray, bits: int) -> bytes:
    odd = np.bincount((shingle_set & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(drawn: bytes, size: int) -> np.ndarray:
    """The sketch of ``size`` bytes, a smaller power of two or the same, of the set that ``drawn`` is of."""
    row = np.frombuffer(drawn, np.uint64)
    while 8 * len(row) > size:
        row = row[: len(row) // 2] ^ row[len(row) // 2 :]
    return row


def tile_keys(shingle_set: np.ndarray, bands: Bands) -> np.ndarray:
    """The distinct keys of a set: for its own band as the smaller and the one before as the larger."""
    own = bands.of(len(shingle_set))
    keys = []
    for tile in {own, max(0, own - 1)}:
        m, k = bands.parts(tile)
        for seed in range(SEEDS):
            with np.errstate(over="ignore"):
                dealt = mixed(shingle_set + np.uint64((seed + 1) * 0xD1B54A32D192ED03 % 2**64))
                part = ((dealt >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
                sums = np.zeros(m, np.uint64)
                np.add.at(sums, part.astype(np.int64), mixed(dealt))
                name = np.arange(m, dtype=np.uint64) + np.uint64((tile * SEEDS + seed) << 40)
                full = np.bincount(part.astype(np.int64), minlength=m) > 0
                keys.append(mixed(sums + mixed(name + np.uint64(1)))[full])
            if m - int(full.sum()) < m - k:
                break
        else:  # so thin in each of the seeds: such sets of one tile meet in one key
            keys.append(mixed(np.array([(tile + 1) << 20], np.uint64)))
    return np.unique(np.concatenate(keys))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A bitmap for each set, of BITS_PER_SHINGLE bits or more a shingle of the largest."""
    width = max(64, 1 << math.ceil(math.log2(max(1, BITS_PER_SHINGLE * max(len(x) for x in sets)))))
    out = np.zeros((len(sets), width // 8), np.uint8)
    for row, x in zip(out, sets):
        at = (x & np.uint64(width - 1)).astype(np.int64)
        np.bitwise_or.at(row, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out.view(np.uint64)


class Unions:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.root(i)] = self.root(j)


def tile_links(sets: list[np.ndarray], low: np.ndarray, side: np.ndarray, across: bool, percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that span what all links of a task connect, and the number of links of each set.

    ``low``: in the tile's own band (two sets of the next band meet in the next tile). ``side``:
    the chunk, 0 or 1; if ``across``, only pairs of two chunks are compared.
    """
    order = np.argsort([len(x) for x in sets], kind="stable")
    sets, low, side = [sets[i] for i in order], low[order], side[order]
    size = np.array([len(x) for x in sets], np.int64)
    bits = signatures(sets)
    ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(size) - size
    marked = np.zeros(len(names), bool)
    unions, found, degree = Unions(len(sets)), [], np.zeros(len(sets), np.int64)
    for i in range(len(sets) - 1):
        if not low[i]:
            break
        end = int(np.searchsorted(size, size[i] * 100 // percent, side="right"))
        near = np.arange(i + 1, end)
        if across:
            near = near[side[near] != side[i]]
        if not len(near):
            continue
        shared = np.bitwise_count(bits[near] & bits[i]).sum(axis=1, dtype=np.int64)
        most = np.minimum(size[i] - (ones[i] - shared), size[near] - (ones[near] - shared))
        near = near[most * (100 + percent) >= percent * (size[i] + size[near])]
        if not len(near):
            continue
        mine = flat[starts[i] : starts[i] + size[i]]
        marked[mine] = True
        for part in np.array_split(near, 1 + int(size[near].sum()) // BLOCK_SHINGLES):
            if not len(part):
                continue
            first = np.cumsum(size[part]) - size[part]
            at = np.arange(int(size[part].sum())) + np.repeat(starts[part] - first, size[part])
            same = np.add.reduceat(marked[flat[at]], first, dtype=np.int64)
            linked = part[100 * same >= percent * (size[i] + size[part] - same)]
            degree[i] += len(linked)
            degree[linked] += 1
            for j in linked.tolist():
                if unions.root(i) != unions.root(j):
                    unions.join(i, j)
                    found.append((int(order[i]), int(order[j])))
        marked[mine] = False
    links = np.zeros(len(sets), np.int64)
    links[order] = degree
    return found, links


def may_link(size: np.ndarray, low: np.ndarray, side: np.ndarray, bits: np.ndarray, across: bool, percent: int) -> list[tuple[int, int]]:
    """Pairs that span what all pairs connect which may link by their sketches. Rows ascend by size;
    ``low``, ``side`` and ``across`` as above."""
    first, second = (np.flatnonzero(side == k) for k in (0, 1)) if across else (np.arange(len(size)),) * 2
    sizes, theirs, lows = size[second], bits[second], int(low[second].sum())
    # The first half of the bits, word by word over all rows, leaves few for the other half.
    half = -(-bits.shape[1] // 2)
    words = np.ascontiguousarray(theirs[:, :half].T)
    kind = np.uint16 if 64 * half < 1 << 16 else np.uint32
    group, apart, pairs = np.arange(len(size)), len(size) - 1, []
    for at, i in enumerate(first.tolist()):
        if not apart:
            break
        start = int(np.searchsorted(sizes, -(-size[i] * percent // 100))) if across else at + 1
        end = int(np.searchsorted(sizes, size[i] * 100 // percent, side="right"))
        end = end if low[i] else min(end, lows)
        if start >= end:
            continue
        differ = np.zeros(end - start, kind)
        for word, own in zip(words, bits[i]):
            differ += np.bitwise_count(word[start:end] ^ own)
        near = start + np.flatnonzero(differ <= int((size[i] + sizes[end - 1]) * (100 - percent) // (100 + percent)))
        rest = np.bitwise_count(theirs[near, half:] ^ bits[i, half:]).sum(axis=1, dtype=np.int64)
        near = near[(differ[near - start] + rest) * (100 + percent) <= (size[i] + sizes[near]) * (100 - percent)]
        near = second[near]
        fresh = near[group[near] != group[i]]
        if len(fresh):
            names, one = np.unique(group[fresh], return_index=True)
            pairs += [(i, j) for j in fresh[one].tolist()]
            group[np.isin(group, names)] = group[i]
            apart -= len(names)
    return pairs


def distinct_pairs(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    fresh = np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]))[: len(u)]
    return u[fresh], v[fresh]


def meetings(key: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of (key, class) entries: the distinct keys, sorted, the least class of each, and distinct
    links (u, v) of the other classes of a key to its least."""
    order = np.lexsort((cls, key))
    key, cls = key[order], cls[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    least = np.repeat(cls[first], np.diff(np.append(first, len(key))))
    others = cls != least
    return key[first], cls[first], *distinct_pairs(cls[others], least[others])


FOUND = "doc_id long, n long, cls long, bucket long, keys binary, classes binary, u long, v long, kind int"
#: Kinds of rows of one pass over the texts: documents, packs of keys, links of classes that share a key,
#: sketches of a pack's classes (in the column of keys).
DOCUMENT, PACK, LINK, SKETCH = 0, 1, 2, 3


def _sets_udf(width: int, percent: int, bits: int, keep: pa.Schema):
    """One pass over the texts: rows of FOUND and ``keep``."""
    bands = Bands(percent)
    names = [part.split()[0] for part in FOUND.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    schema = pa.schema([(n, kinds[part.split()[1]]) for n, part in zip(names, FOUND.split(", "))] + list(keep))

    def rows(kind: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        columns["kind"] = pa.array(np.full(size, kind, np.int32))
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def packed(keys: dict[int, np.ndarray], drawn: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        n, sketches = zip(*drawn)
        yield rows(SKETCH, {"cls": pa.array(list(keys), pa.int64()), "n": pa.array(n, pa.int64()), "keys": pa.array(sketches, pa.binary())})
        owner = np.repeat(np.array(list(keys), np.int64), [len(k) for k in keys.values()])
        dropped = np.uint64(max(0, 64 - bits - KEY_BITS))
        flat, least, u, v = meetings(np.concatenate(list(keys.values())) >> dropped << dropped, owner)
        lead = (flat >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(flat), np.int64)
        edges = np.append(np.flatnonzero(np.diff(lead, prepend=-1)), len(lead))
        cuts = list(zip(edges[:-1], edges[1:]))
        yield rows(
            PACK,
            {
                "bucket": pa.array(lead[edges[:-1]]),
                "keys": pa.array([packed_sorted(flat[a:b]) for a, b in cuts], pa.binary()),
                "classes": pa.array([least[a:b].tobytes() for a, b in cuts], pa.binary()),
            },
        )
        if len(u):
            yield rows(LINK, {"u": pa.array(u), "v": pa.array(v)})

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = held("hashes", WordHashes)
        pack: dict[int, np.ndarray] = {}
        drawn: list[tuple[int, bytes]] = []
        size = 0
        for batch in batches:
            n, ids = [], []
            for text in batch.column(1).cast(pa.large_binary()):
                raw = text.as_py() or b""
                found = shingles(raw, width, hashes)
                name = set_id(found) if len(found) else None
                n.append(len(found))
                ids.append(name)
                if name is not None and name not in pack:
                    pack[name] = tile_keys(found, bands)
                    drawn.append((len(found), sketch(found, bands.bits(bands.of(len(found))))))
                    size += len(raw)
                    if size > PACK_BYTES:
                        yield from packed(pack, drawn)
                        pack, drawn, size = {}, [], 0
            kept = dict(zip(keep.names, batch.columns[2:]))
            yield rows(DOCUMENT, {"doc_id": batch.column(0), "n": pa.array(n, pa.int64()), "cls": pa.array(ids, pa.int64())} | kept)
        if pack:
            yield from packed(pack, drawn)

    return sets


def _shared_keys(group: pa.Table) -> pa.Table:
    """Of a bucket: links (u, v) of the classes of a key to its least."""
    held("keys")
    keys = [unpacked_sorted(k.as_py()) for k in group.column("keys")]
    classes = [np.frombuffer(c.as_py(), np.int64) for c in group.column("classes")]
    _, _, u, v = meetings(np.concatenate(keys), np.concatenate(classes))
    return pa.table({"u": pa.array(u), "v": pa.array(v)})


SEATS = "array<struct<tile:int,chunks:int,low:boolean>>"


def _describe_udf(width: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = held("hashes", WordHashes)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [packed_sorted(shingles(t.as_py() or b"", width, hashes)) for t in part.column(1).cast(pa.large_binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(sets, pa.binary())], ["cls", "grp", "seats", "arr"])

    return describe


def _sketch_tile(percent: int):
    def tile(group: pa.Table) -> pa.Table:
        held("sketches")
        order = np.argsort(group.column("n").to_numpy(), kind="stable")
        cls, size, side = (group.column(name).to_numpy()[order] for name in ("cls", "n", "side"))
        low = group.column("low").to_numpy(zero_copy_only=False)[order]
        pairs = []
        if low.any() and len(cls) > 1:
            drawn = group.column("keys").to_pylist()
            width = min(map(len, drawn))
            bits = np.stack([folded(drawn[i], width) for i in order.tolist()])
            across = group.column("a")[0].as_py() != group.column("b")[0].as_py()
            pairs = may_link(size, low, side, bits, across, percent)
        return pa.table({name: pa.array([cls[pair[k]] for pair in pairs], pa.int64()) for k, name in enumerate(("u", "v"))})

    return tile


def _blocks(rows: np.ndarray, arrays: pa.ChunkedArray) -> list[np.ndarray]:
    """``rows`` cut to blocks of about BLOCK_SHINGLES shingles, of seven packed bytes each."""
    sizes = np.array([len(arrays[int(i)].as_buffer()) for i in rows], np.int64)
    return [b for b in np.split(rows, np.flatnonzero(np.diff(np.cumsum(sizes) // (7 * BLOCK_SHINGLES))) + 1) if len(b)]


def _tile(percent: int):
    def tile(group: pa.Table) -> pa.Table:
        held("tile")
        cls = group.column("cls").to_numpy()
        low = group.column("low").to_numpy(zero_copy_only=False)
        arrays = group.column("arr")
        if not low.any() or len(cls) < 2:
            return pa.table({name: pa.array([], pa.int64()) for name in ("u", "v", "n")})
        if group.column("a")[0].as_py() == group.column("b")[0].as_py():
            blocks = _blocks(np.arange(len(cls)), arrays)
            meets = [(blocks[i], blocks[j]) for i in range(len(blocks)) for j in range(i, len(blocks))]
        else:
            side = group.column("side").to_numpy()
            ours, theirs = (_blocks(np.flatnonzero(side == k), arrays) for k in (0, 1))
            meets = [(x, y) for x in ours for y in theirs]
        unions, pairs, links = Unions(len(cls)), [], np.zeros(len(cls), np.int64)
        for x, y in meets:
            rows = x if x is y else np.concatenate((x, y))
            if len(rows) < 2 or not low[rows].any():
                continue
            side = np.repeat([0, 1], [len(x), len(rows) - len(x)])
            found, degree = tile_links([unpacked_sorted(arrays[int(i)].as_py()) for i in rows], low[rows], side, x is not y, percent)
            links[rows] += degree
            for i, j in found:
                i, j = int(rows[i]), int(rows[j])
                if unions.root(i) != unions.root(j):
                    unions.join(i, j)
                    pairs.append((i, j))
        some = np.flatnonzero(links)
        u = [cls[i] for i, _ in pairs] + cls[some].tolist()
        v = [cls[j] for _, j in pairs] + [None] * len(some)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n": pa.array([None] * len(pairs) + links[some].tolist(), pa.int64())})

    return tile


def _band_udf(percent: int):
    bands = Bands(percent)

    def band(n: pa.Array) -> pa.Array:
        return pa.array([bands.of(x) for x in n.to_pylist()], pa.int32())

    return F.arrow_udf(band, "int")


def _seated(member: DataFrame, percent: int, share: Column) -> DataFrame:
    """(cls, grp, _id, seats) of the classes (cls, grp, _id, n) that meet another in a tile of their
    group: a tile of two or more, of which one is of the tile's own band. Others need no text.
    ``share``: of a chunk, that a class of n shingles takes."""
    own = member.withColumn("band", _band_udf(percent)("n"))
    tiles = F.explode(F.array_distinct(F.array(F.col("band"), F.greatest(F.lit(0), F.col("band") - 1)))).alias("tile")
    each = table(own.select("cls", "grp", "_id", "n", "band", tiles), "seats")
    sizes = each.groupBy("grp", "tile").agg(F.sum(share).alias("total"), F.count(F.lit(1)).alias("members"), F.count_if(F.col("band") == F.col("tile")).alias("lows"))
    sizes = sizes.filter("members > 1 and lows > 0").select("grp", "tile", F.ceil("total").cast("int").alias("chunks"))
    seat = F.struct("tile", "chunks", (F.col("band") == F.col("tile")).alias("low"))
    found = table(each.join(sizes, ["grp", "tile"]).groupBy("cls", "grp", "_id").agg(F.collect_list(seat).cast(SEATS).alias("seats")), "members")
    forget(each)
    return found


def _meetings(seated: DataFrame, *columns: str) -> GroupedData:
    """Classes (cls, grp, seats) and ``columns`` by the pairs of chunks in which they meet."""
    placed = seated.select("cls", "grp", F.inline("seats"), *columns).withColumn("chunk", F.pmod(F.xxhash64("cls"), "chunks").cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = pairs.select("grp", "tile", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "cls", "low", (F.col("chunk") > F.col("other")).cast("int").alias("side"), *columns)
    return rows.groupBy("grp", "tile", "a", "b")


def _candidates(member: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """A table (node, root) of the classes (cls, grp, _id, n) that may link by their sketches (cls, n,
    keys), which may repeat, with another of their group: root is the least that such pairs reach."""
    seats = _seated(member, percent, F.greatest(F.col("n") / (4 * SKETCH_BYTES), F.lit(1 / SKETCH_ROWS)))
    drawn = sketches.join(seats.select("cls", "grp", "seats"), "cls").dropDuplicates(["cls"])
    near = table(_meetings(drawn, "n", "keys").applyInArrow(_sketch_tile(percent), "u long, v long"), "near")
    forget(seats)
    found = components(near)
    forget(near)
    return found


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of classes (cls, grp, seats, arr) that span those of each candidate group; where v
    is null, n links of class u."""
    return table(_meetings(sets, "arr").applyInArrow(_tile(percent), "u long, v long, n long"), "links")


def _members(groups: DataFrame, classes: DataFrame) -> DataFrame:
    return groups.select(F.col("node").alias("cls"), F.col("root").alias("grp")).join(classes.select("cls", "_id", "n"), "cls")


def ngram_join(docs: DataFrame, width: int = 5, percent: int = 80, keep: tuple[str, ...] = ()) -> DataFrame:
    """Links rows of ``docs`` (doc_id, text) whose sets of ``width``-word shingles have a Jaccard
    similarity of ``percent`` / 100 or more.

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer words is one
    shingle. Returns doc_id, n_shingles, class_id (smallest doc_id of an equal set), component_id
    (smallest doc_id that links reach), n_links (other classes that the row's class links with),
    kept (true for one row of each component, of smallest doc_id, null before all others) and the
    columns of ``keep``. Texts that are null, empty or without words have no shingles and link with
    nothing: class and component are their own doc_id, and all are kept. Repeated rows are equal
    sets. Different texts may share a doc_id or have none; ids are then equal or null, while links
    and kept go by the sets. No rows give no rows; other columns are ignored. Sets are equal when
    their 64-bit digests are; shingles when their 64-bit hashes are.
    """
    ship(docs.sparkSession)
    # A text is found again by its doc_id and two hashes: doc_ids may repeat or be null.
    source = docs.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("_id"), *(F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)))
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[2:])
    extra = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in source.schema.fields[2:]])
    # Keys by the bytes of text: a word has about six, and a set has keys for a share of its shingles.
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = size / 6 * 3 * (100 - percent) / percent
    bits = max(0, math.ceil(math.log2(max(1, expected / BUCKET_KEYS))))
    found = table(source.mapInArrow(_sets_udf(width, percent, bits, extra), FOUND + kinds).withColumn("_row", F.monotonically_increasing_id()), "sets", by="kind")
    narrow = found.filter(F.col("kind") == DOCUMENT).select("doc_id", "n", "cls", "_row", "_id", *source.columns[3:])
    classes = narrow.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("class_id"), F.min("_id").alias("_id"), F.max("n").alias("n"), F.min(F.struct("doc_id", "_row")).alias("_first"))
    classes = table(classes, "classes")

    packs = found.filter(F.col("kind") == PACK).select("bucket", "keys", "classes")
    far = packs.groupBy("bucket").applyInArrow(_shared_keys, "u long, v long")
    shared = table(far.union(found.filter(F.col("kind") == LINK).select("u", "v")), "shared")
    forget(found, part=f"kind={PACK}")
    grouped = components(shared)
    near = _candidates(_members(grouped, classes), found.filter(F.col("kind") == SKETCH).select("cls", "n", "keys"), percent)
    forget(shared, grouped)
    forget(found, part=f"kind={SKETCH}")
    member = _seated(_members(near, classes), percent, F.col("n") / (BLOCK_SHINGLES * CHUNK_BLOCKS))
    forget(near)
    # One path at every size: the texts of candidate classes are brought together by a shuffle.
    texts = source.select("text", "_id").join(member.hint("merge"), "_id").groupBy("cls").agg(F.first("text").alias("text"), F.first("grp").alias("grp"), F.first("seats").alias("seats"))
    links = _links(texts.select("cls", "text", "grp", "seats").mapInArrow(_describe_udf(width), f"cls long, grp long, seats {SEATS}, arr binary"), percent)
    forget(member)

    roots = components(links.filter("v is not null").select("u", "v"))
    root = roots.withColumnRenamed("node", "cls")
    counts = links.filter("v is null").groupBy(F.col("u").alias("cls")).agg(F.sum("n").alias("n_links"))
    named = classes.drop("_id", "n").join(root, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    low = named.groupBy("root").agg(F.min("class_id").alias("component_id"), F.min("_first").alias("_first"))
    named = table(named.drop("_first").join(low, "root").join(counts, "cls", "left").select("cls", "class_id", "component_id", "n_links", F.col("_first._row").alias("_kept")), "named")
    forget(links, roots, classes)
    return narrow.join(named, "cls", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("cls").isNull() | (F.col("_kept") == F.col("_row"))).alias("kept"),
        *(F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)),
    )
