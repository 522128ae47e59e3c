"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

Words are runs of non-blank characters (blank: space and U+0009 to U+000D) with A-Z lower-cased; a
document's set holds its distinct word shingles (the whole sequence if it has fewer words). Documents
with equal sets form one class, which goes on as a single node. Two nodes are linked when their sets'
similarity is at least `percent`/100, tested on the full sets in integers.

Search. A node is posted under each of its `coordinates` (coordinate, minimum) pairs. Two sets of
similarity s agree in each coordinate with probability s, so linked nodes share at least `matches`
postings but for a chance below `miss` (matches is derived from it). From there every step is exact:

- skip: postings under which no other node stands cannot collide, and a node with fewer than `matches`
  shared postings has no partner; both leave at once;
- bound: shingles that no other node left holds are in no intersection; a node with too many of them has
  no partner, and a pair with too many is not made;
- stars: under every posting the node with the fewest such shingles, as a share, is paired with the others
  (as many pairs as postings, no matter how many nodes stand there); pairs that collide often are
  verified, and the links found merge a large group of copies into one component;
- prefix: what could still join two components is found by prefix merging: a node's shared postings are
  ordered from rare to common, and of m of them only the first m - matches + 1 are joined, because two
  nodes with `matches` postings in common share one of those; collisions are counted on the signatures,
  pairs above the threshold are verified. Pairs inside one component are never made;
- blocks: a node that shares a prefix posting with a component of LARGE members or more meets all its
  members of a size that a link allows, sets packed into blocks of bounded size, so that no pair becomes
  a row.

No list, group or component is gathered in a task or on the driver: lists are joined by key, counts are
pre-aggregated, components come from star rounds over the edge table. Nothing is capped.

Edge cases: null, empty and blank texts have an empty set, are linked with nothing and form their own
component; rows that repeat a document are nodes of one class; a row with a null id is linked
like any other, and its component is null only if no row of the component has an id. Extra columns are
ignored by `components` and carried by `survivors`. Texts of any length are hashed in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillboard.llm.common import cut, join_hot, maybe_broadcast, release_memory, small_batches
from quillboard.llm.components import connected_components

BLOCK_BYTES = 1 << 18
BROADCAST_IDS = 1_000_000
#: Components from so many members on are compared with other nodes in blocks.
LARGE = 64
BLOCK_ELEMENTS = 100_000
#: Nodes of a posting from which on they are paired in parts.
LIST = 1000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True
_FACTOR = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, 64-bit hash) of every word of a row of bytes that ends with a blank, in pieces cut behind blanks."""
    firsts, hashes, start = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while start < len(data):
        end = min(len(data), start + 2 * BLOCK_BYTES)
        if end < len(data):
            blank = _BLANK[data[end - 1 :]] if not _BLANK[data[end - 1]] else None
            end = len(data) if blank is not None and not blank.any() else end if blank is None else end + int(blank.argmax())
        part = _LOWER[data[start:end]]
        inside = ~_BLANK[part]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        starts = np.flatnonzero(begins)
        if len(starts):
            at = np.flatnonzero(inside)
            index = np.searchsorted(at, starts)
            length = np.diff(index, append=len(at))
            place = np.arange(len(at)) - np.repeat(index, length)
            powers = np.cumprod(np.full(min(int(length.max()), 1 << 20), _FACTOR[0], dtype=np.uint64))
            far = (place >> 20).astype(np.uint64)
            words = np.add.reduceat((part[at].astype(np.uint64) + np.uint64(1) + far * np.uint64(0x2545F4914F6CDD1D)) * powers[place & ((1 << 20) - 1)], index)
            firsts.append(starts + start)
            hashes.append(_mix(words + length.astype(np.uint64) * _FACTOR[1]))
        start = end
    return np.concatenate(firsts), np.concatenate(hashes)


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of the texts in a row, and the first of each text (and the end)."""
    starts, words = _words(np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8))
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    first = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    many = np.diff(first)
    factors = np.resize(_FACTOR, size) + np.arange(size, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E01A)
    total = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
    for k in range(size):
        total += words[k : len(words) - size + 1 + k] * factors[k]
    long = many >= size
    counts = np.where(long, many - size + 1, np.minimum(many, 1))
    ends = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(int(ends[-1]), dtype=np.uint64)
    owner = np.repeat(np.arange(len(texts)), counts)
    take = np.repeat(first[:-1], counts) + np.arange(len(out)) - np.repeat(ends[:-1], counts)
    whole = long[owner]
    out[whole] = total[take[whole]]
    for t in np.flatnonzero(~long & (many > 0)):
        part = words[first[t] : first[t + 1]]
        out[ends[t]] = ((part * factors[: len(part)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(part)) * _FACTOR[2 : 3])[0]
    return _mix(out), ends


def multipliers(coordinates: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(hashes: np.ndarray, ends: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Top 32 bits of each text's minimum in every coordinate; texts without shingles are left at 0."""
    out = np.zeros((len(ends) - 1, len(by)), dtype=np.uint32)
    full = np.flatnonzero(np.diff(ends))
    if len(full):
        for j, factor in enumerate(by):
            out[full, j] = np.minimum.reduceat(hashes * factor, ends[full]) >> np.uint64(32)
    return out


def _byte_blocks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    held, size, start = [], 0, 0
    for i, value in enumerate(column.cast(pa.binary()).to_pylist()):
        value = value or b""
        if held and size + len(value) > BLOCK_BYTES:
            yield start, held
            held, size, start = [], 0, i
        held.append(value)
        size += len(value) + 1
    if held:
        yield start, held


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    for start, texts in _byte_blocks(column):
        hashes, ends = shingles(texts, size)
        yield start, hashes, ends, [np.unique(hashes[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _key(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _digest(text_col: str) -> Column:
    """With the id, what tells a row from others: rows equal in both share one set and one decision."""
    return F.unhex(F.sha2(F.col(f"`{text_col}`").cast("string").cast("binary"), 256))


def signed(df: DataFrame, id_col: str, text_col: str, size: int, coordinates: int, seed: int) -> DataFrame:
    """id, digest of the text, n_shingles, key of the set, signature of every row."""
    by = multipliers(coordinates, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            n, keys, sigs = [], [], []
            for _, hashes, ends, sets in _sets(batch.column(1), size):
                n += [len(s) for s in sets]
                keys += [_key(s) for s in sets]
                sigs.append(signatures(hashes, ends, by).view(np.int32))
            flat = np.concatenate(sigs).ravel() if sigs else np.zeros(0, np.int32)
            offsets = np.arange(len(n) + 1, dtype=np.int32) * coordinates
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "digest", "n", "key", "sig"])
        release_memory()

    source = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), _digest(text_col).alias("digest"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, digest binary, n bigint, key binary, sig array<int>")


def full_sets(df: DataFrame, id_col: str, text_col: str, size: int, wanted: DataFrame, rows: int) -> DataFrame:
    """node, set: full shingle sets of the nodes in `wanted` (node, key, rep), read from the texts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 0):
            for _, _, _, sets in _sets(batch.column(0), size):
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["key", "set"])
        release_memory()

    source = df.select(F.col(f"`{id_col}`").alias("rep"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ids = wanted.select("rep").distinct()
    chosen = source.join(F.broadcast(ids) if rows <= BROADCAST_IDS else ids, "rep", "left_semi").select("text")
    # a class without any id: a join finds no null, and would deal all of them to one task
    if not wanted.where("rep IS NULL").isEmpty():
        chosen = chosen.unionByName(source.where("rep IS NULL").select("text"))
    found = chosen.mapInArrow(run, "key binary, set array<bigint>")
    # an id that several rows bear, or that rows lack, may bring the same set more than once
    return found.join(maybe_broadcast(wanted.select("key", "node"), rows, BROADCAST_IDS), "key").groupBy("node").agg(F.first("set").alias("set"))


def least_matches(coordinates: int, percent: int, miss: float) -> int:
    """The largest T such that a pair at the threshold agrees in fewer than T coordinates with chance < miss."""
    s, below = percent / 100, 0.0
    for t in range(coordinates + 1):
        below += comb(coordinates, t) * s**t * (1 - s) ** (coordinates - t)
        if below >= miss:
            return max(1, t)
    return coordinates


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked, by their full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b")).cast("bigint")
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b")).cast("bigint").alias("sizes"))
    return joined.where(F.col("both") * 100 >= (F.col("sizes") - F.col("both")) * percent).select("a", "b")


def links(df: DataFrame, id_col: str, text_col: str, classes: DataFrame, size: int, percent: int, coordinates: int, matches: int) -> DataFrame | None:
    """(node, component) of every node that has a link; None if no node has."""
    posted = classes.select("node", F.posexplode("sig").alias("j", "v")).select("node", (F.shiftleft(F.col("j").cast("bigint"), 32) + F.col("v").cast("bigint").bitwiseAND(0xFFFFFFFF)).alias("token"))
    shared = posted.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    postings = cut(posted.join(shared, "token").select("node", "token", "c"))
    alive = cut(postings.groupBy("node").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= matches))
    n = alive.count()
    if not n:
        return None
    postings = postings.join(maybe_broadcast(alive, n), "node")
    wanted = cut(classes.join(maybe_broadcast(alive.select("node"), n), "node").select("node", "key", "rep"))
    sets = cut(full_sets(df, id_col, text_col, size, wanted, n))

    # a shingle that no other node holds is in no intersection: an exact bound on any partner's similarity
    own = sets.select("node", F.explode("set").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where("c = 1")
    own = own.groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    sized = sets.select("node", F.size("set").cast("bigint").alias("n")).join(own, "node", "left").select("node", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common"))
    sized = cut(sized.where(F.col("common") * 100 >= F.col("n") * percent))
    n = sized.count()
    postings = cut(postings.join(maybe_broadcast(sized, n), "node"))

    first = postings.groupBy("token").agg(F.min(F.struct((1 - F.col("common") / F.col("n")).alias("own"), "node")).alias("hub"))
    stars = postings.select("token", F.col("node").alias("b")).join(first.select("token", F.col("hub.node").alias("a")), "token").where("a <> b")
    stars = stars.groupBy("a", "b").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= max(1, matches // 3))
    found = cut(_verified(stars, sets, percent))
    merged = cut(connected_components(found, "a", "b"))
    large = cut(merged.groupBy("component").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= LARGE).select("component"))
    n_large = large.count()

    rare = Window.partitionBy("node").orderBy("c", "token")
    prefix = postings.withColumn("rank", F.row_number().over(rare)).where(F.col("rank") <= F.col("m") - matches + 1)
    prefix = prefix.select("node", "token", "n", "common").join(merged, "node", "left").withColumn("component", F.coalesce("component", "node"))
    prefix = cut(join_hot(prefix, large.withColumn("large", F.lit(True)), "component", "node", n_large, "left").withColumn("large", F.coalesce("large", F.lit(False))))
    open_lists = prefix.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    prefix = cut(prefix.join(open_lists, "token"))

    # between small components: pairs that the bounds leave, each made under the first posting they share
    heads = prefix.where("NOT large")
    heads = heads.join(heads.groupBy("node").agg(F.sort_array(F.collect_list("token")).alias("tokens")), "node")  # at most `coordinates`
    lists = cut(heads.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / LIST).cast("int").alias("parts")).where("parts > 1"))
    heads = cut(join_hot(heads, lists, "token", "node", lists.count(), "left").withColumn("parts", F.coalesce("parts", F.lit(1))))
    # the nodes of a long list are dealt into parts, and each part meets every other in a task of its own
    left = heads.select("token", "parts", F.pmod(F.xxhash64("node"), "parts").alias("pa"), F.col("node").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("common").alias("ka"), F.col("tokens").alias("ta"))
    left = left.withColumn("pb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1))).drop("parts")
    right = heads.select("token", "parts", F.pmod(F.xxhash64("node"), "parts").alias("pb"), F.col("node").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("common").alias("kb"), F.col("tokens").alias("tb"))
    right = right.withColumn("pa", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1))).drop("parts")
    bound = F.least("ka", "kb") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    earliest = F.array_min(F.array_intersect("ta", "tb")) == F.col("token")
    pairs = left.join(right, ["token", "pa", "pb"]).where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & bound & earliest).select("a", "b")
    sig = classes.select("node", "sig")
    agree = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
    pairs = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b").where(agree >= matches).select("a", "b")
    rest = cut(_verified(pairs, sets, percent))
    if n_large:
        members = join_hot(merged, large, "component", "node", n_large)
        rest = cut(rest.unionByName(_against_large(prefix, members, sets, percent)))
    if rest.isEmpty():
        return None if merged.isEmpty() else merged
    return cut(connected_components(merged.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(rest), "a", "b"))


def _against_large(prefix: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between nodes and large components of which they share a posting, block against block.

    A node meets the members whose sets are not too small or too large for a link, but no pair becomes a
    row: sets of like size are packed into blocks of about BLOCK_ELEMENTS shingles, and a node gives one
    link to each block at most.
    """
    inside = prefix.where("large").select("token", F.col("component").alias("whole")).distinct()
    meets = prefix.join(inside, "token").where((F.col("component") != F.col("whole")) & (~F.col("large") | (F.col("component") > F.col("whole"))))
    meets = cut(meets.select("whole", "node").distinct())

    def packed(pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame, int]:
        """Blocks of each component's sets by range of sizes, how many blocks each range has, and of how many ranges."""
        held = pairs.join(sets, "node").withColumn("range", size_range(F.size("set"), percent))
        held = held.withColumn("of", F.struct("whole", "range"))
        many = cut(held.groupBy("of").agg(F.ceil(F.sum(F.size("set").cast("bigint")) / BLOCK_ELEMENTS).cast("int").alias("blocks")))
        n = many.count()
        held = join_hot(held, many, "of", "node", n).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        return held.groupBy("of", "block").agg(F.collect_list(F.struct("node", "set")).alias(name)), many, n

    # every block of members is sent to each block of other nodes in its own and the two next ranges: the
    # work is dealt by (component, range, block)
    outside, parts, n = packed(meets, "outside")
    inside, _, _ = packed(members.select(F.col("component").alias("whole"), "node"), "inside")
    sent = inside.select(F.col("of.whole").alias("whole"), F.explode(F.sequence(F.col("of.range") - 1, F.col("of.range") + 1)).alias("range"), "block", "inside")
    sent = join_hot(sent.select(F.struct("whole", "range").alias("of"), F.col("block").alias("from"), "inside"), parts, "of", "from", n)
    sent = sent.select("of", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "inside")
    blocks = outside.join(sent, ["of", "block"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for row in range(batch.num_rows):
                nodes, flat, starts = _unpacked(batch.column(0), row)
                known, place = np.unique(flat, return_inverse=True)
                sizes = np.diff(starts, append=len(flat))
                theirs, other, begin = _unpacked(batch.column(1), row)
                for node, one in zip(theirs, np.split(other, begin[1:]), strict=True):
                    at = np.minimum(np.searchsorted(known, one), len(known) - 1)
                    mark = np.zeros(len(known), dtype=np.int64)
                    mark[at[known[at] == one]] = 1
                    both = np.add.reduceat(mark[place], starts)
                    linked = np.flatnonzero(both * 100 >= (sizes + len(one) - both) * percent)
                    if len(linked):
                        a.append(int(nodes[linked[0]]))
                        b.append(int(node))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return blocks.select("inside", "outside").mapInArrow(compare, "a bigint, b bigint")


def size_range(n: Column, percent: int) -> Column:
    """Ranges of set sizes: linked sets are in the same range or in neighbouring ones."""
    if percent >= 100:
        return n.cast("int")
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")


def _unpacked(column: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, their sets in a row, first element of each set) of one list of (node, set)."""
    offsets = column.offsets
    items = column.values.slice(offsets[row].as_py(), offsets[row + 1].as_py() - offsets[row].as_py())
    sets = items.field(1)
    bounds = sets.offsets.to_numpy()
    return items.field(0).to_numpy(), sets.values.to_numpy()[bounds[0] : bounds[-1]], (bounds - bounds[0])[:-1]


def _marked(df: DataFrame, id_col: str, text_col: str, size: int = 5, percent: int = 80, coordinates: int = 64, miss: float = 1e-5, seed: int = 17) -> DataFrame:
    """One row per input row: id, digest of the text, n, component (an id), whole (the component's number)."""
    matches = least_matches(coordinates, percent, miss)
    rows = cut(signed(df, id_col, text_col, size, coordinates, seed))
    grouped = rows.where("n > 0").groupBy("key").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"))
    # the key is rebuilt so that the written frame is not taken as dealt by it: a hot key must stay divisible
    classes = cut(grouped.select(F.monotonically_increasing_id().alias("node"), F.concat("key", F.lit(b"")).alias("key"), "rep", "sig"))
    linked = links(df, id_col, text_col, classes, size, percent, coordinates, matches)
    named = classes.select("key", F.col("rep").alias("label"), F.col("node").alias("whole"))
    if linked is not None:
        ids = classes.select("node", "key", "rep").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = cut(ids.groupBy("component").agg(F.min("rep").alias("label"), F.count(F.lit(1)).alias("c")).where("c > 1").select("component", "label"))
        named = join_hot(ids, least, "component", "node", least.count(), "left")
        # a component of one class has the class's own id; one of several has the least id, null if none has one
        named = cut(named.select("key", F.coalesce("label", "rep").alias("label"), F.col("component").alias("whole")))
    out = rows.select("id", "digest", "n", "key").join(named, "key", "left")
    return out.select("id", "digest", "n", F.when(F.col("n") > 0, F.col("label")).otherwise(F.col("id")).alias("component"), "whole")


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, coordinates: int = 64, miss: float = 1e-5, seed: int = 17) -> DataFrame:
    """One row per input row: `id_col`, n_shingles, component_id, kept (its id is that of the component).

    Rows that repeat an id of a component's name are all kept, as are rows without id in a component
    where none has an id: `survivors` takes one of them.
    """
    out = _marked(df, id_col, text_col, size, percent, coordinates, miss, seed)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def survivors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each component, and every row without words.

    The row of the smallest id stays; of rows that share it, that of the smallest text digest, and one of
    those that are equal in both. Rows without id stay only where their component has no id. Decisions go
    by row (id and text), so other texts that bear a dropped row's id, or lack one too, are left alone.
    """
    marked = cut(_marked(df, id_col, text_col, **how).where("n > 0").select("id", "digest", "whole"))
    one = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    heads = cut(marked.groupBy("whole").agg(F.min(one).alias("head"), F.count(F.lit(1)).alias("c")).where("c > 1").select("whole", "head"))
    n = heads.count()
    if not n:
        return df
    grouped = join_hot(marked, heads, "whole", "digest", n)
    is_head = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("digest") == F.col("head.digest"))
    gone = grouped.where(~is_head).select(F.col("id").alias("__qb_id"), F.col("digest").alias("__qb_text")).distinct()
    again = cut(grouped.where(is_head).groupBy("whole").agg(F.count(F.lit(1)).alias("c"), F.first("head").alias("head")).where("c > 1").select(F.col("head.id").alias("__qb_id"), F.col("head.digest").alias("__qb_text")))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__qb_id")) & (_digest(text_col) == F.col("__qb_text"))
    kept = df.join(gone, same, "left_anti")
    if again.isEmpty():
        return kept
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([id_col, text_col]))
