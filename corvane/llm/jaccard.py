"""Exact Jaccard join of word shingle sets: size-banded tiles of bitmap signatures, then sorted-array intersection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import filter_bits, id_back, in_filter, keyed, lists, map_batches, map_partitions, stored, texts
from corvane.llm.components import components
from corvane.llm.shingles import shingle_set

WORDS = 5
NUM, DEN = 3, 4  # the least similarity, 3/4; sizes in a band differ by that factor at most
BLOCK = 4096  # documents whose shingles are counted together
SEEN = 4  # sets of a block that a shingle must be in to be counted as common
COMMON = 1 << 17  # shingles that come last in the order: a broadcast of a MB at most
TILE = 2048  # documents on a side of a tile
TILE_SHINGLES = 1 << 27  # their shingles: bitmaps of 64 MB at most
FEW = 32  # rows of a tile that are compared one pair at a time
FIRSTS = 8  # keys that a set lists, so that a pair is given under one of them
PARTNERS = 1024  # documents that are compared with one home in one task


def similar(shared: int, a: int, b: int) -> bool:
    return DEN * shared >= NUM * (a + b - shared)


def signature(shingles: np.ndarray) -> bytes:
    """A bitmap with two to four bits per shingle; each shingle flips one bit."""
    bits = 2 << max(6, int(len(shingles) - 1).bit_length())
    flips = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def most_shared(a: int, x: bytes, b: int, y: bytes) -> int:
    """The most shingles that sets of ``a`` and ``b`` can share: every differing bit needs one that they do not.

    The wider bitmap is folded to the width of the other; folding flips the same bits as hashing to that width.
    """
    return (a + b - differing(int.from_bytes(x, "little"), len(x), int.from_bytes(y, "little"), len(y))) // 2


def differing(p: int, p_bytes: int, q: int, q_bytes: int) -> int:
    while p_bytes > q_bytes:
        p_bytes //= 2
        p = (p >> (8 * p_bytes)) ^ (p & ((1 << (8 * p_bytes)) - 1))
    while q_bytes > p_bytes:
        q_bytes //= 2
        q = (q >> (8 * q_bytes)) ^ (q & ((1 << (8 * q_bytes)) - 1))
    return (p ^ q).bit_count()


def profiles(rows: DataFrame, words: int) -> DataFrame:
    """``id, n, digest`` per text, and rows ``mer, seen`` for shingles that stand out in a block of documents.

    A shingle in a given share of all texts has that share in some block, so none is overlooked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[np.ndarray] = []
        known: set[bytes] = set()
        size = 0

        def frequent() -> tuple[np.ndarray, np.ndarray]:
            mers, many = np.unique(np.concatenate(block), return_counts=True) if block else (np.empty(0, np.uint64), np.empty(0, np.int64))
            often = many >= SEEN
            return mers[often].view(np.int64), many[often]

        def out(ids, sizes, digests, mers, many) -> pa.RecordBatch:
            k, m = len(ids), len(mers)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids + [None] * m, pa.int64()), pa.array(sizes + [None] * m, pa.int64()), pa.array(digests + [None] * m, pa.binary()),
                    pa.array([None] * k + mers.tolist(), pa.int64()), pa.array([None] * k + many.tolist(), pa.int64()),
                ],
                ["id", "n", "digest", "mer", "seen"],
            )

        none = np.empty(0, np.int64)
        for batch in batches:
            found = [shingle_set(t, words) for t in texts(batch.column(1))]
            digests = [xxhash.xxh3_128_digest(s) for s in found]
            yield out(batch.column(0).to_pylist(), [len(s) for s in found], digests, none, none)
            for s, d in zip(found, digests, strict=True):
                if d not in known:  # equal sets count once
                    known.add(d)
                    block.append(s)
                    size += len(s)
            if len(block) >= BLOCK or size >= 2_000_000:
                yield out([], [], [], *frequent())
                block, size, known = [], 0, set()
        yield out([], [], [], *frequent())

    return map_partitions(rows, run, "id long, n long, digest binary, mer long, seen long")


def indexed(rows: DataFrame, common: np.ndarray, words: int) -> DataFrame:
    """``id, n, digest, sig, keys``: the keys are a set's first quarter in an order that is the same for all.

    Sets with a similarity of 3/4 share one of them, whatever the order. Common shingles come last, so that
    a passage in very many documents is no key of theirs.
    """
    last = rows.sparkSession.sparkContext.broadcast(common)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, sizes, digests, sigs, keys = [], [], [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            s = shingle_set(text, words)
            n = len(s)
            if not n:
                continue
            often = np.zeros(n, dtype=bool)
            if len(last.value):
                often = last.value[np.minimum(np.searchsorted(last.value, s), len(last.value) - 1)] == s
            ids.append(doc)
            sizes.append(n)
            digests.append(xxhash.xxh3_128_digest(s))
            sigs.append(signature(s))
            keys.append(np.concatenate([s[~often], s[often]])[: n - (NUM * n + DEN - 1) // DEN + 1].view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), lists(keys, pa.int64())],
            ["id", "n", "digest", "sig", "keys"],
        )

    return map_batches(rows, run, "id long, n long, digest binary, sig binary, keys array<long>")


def runs(sets: DataFrame) -> DataFrame:
    """``key, id, n, leader``: the rows of keys that several sets have, each with the first set of its size band.

    Rows are range-sorted by key, size and id, so a key with very many sets spreads over tasks; a band then
    has a leader in each of them. The outermost rows of a task are always given, as their key may go on next door.
    """
    rows = sets.select(F.explode("keys").alias("key"), "id", F.col("n")).repartitionByRange("key", "n", "id").sortWithinPartitions("key", "n", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3  # the last row waits for its successor
        before = None  # key of the row before ``held``; None at the start, so the first row is given
        leader = (0, 0, 0)  # key, id, size

        def give(key, doc, n, shared) -> pa.RecordBatch:
            nonlocal leader
            at = np.flatnonzero(shared)
            first = []
            for k, d, m in zip(key[at].tolist(), doc[at].tolist(), n[at].tolist(), strict=True):
                if leader[0] != k or NUM * m > DEN * leader[2] or not first and leader[2] == 0:
                    leader = (k, d, m)
                first.append(leader[1])
            return pa.RecordBatch.from_arrays(
                [pa.array(key[at]), pa.array(doc[at]), pa.array(n[at]), pa.array(first, pa.int64())], ["key", "id", "n", "leader"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc, n = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True))
            follows = key[1:] == key[:-1]
            opening = np.array([before is None or before == key[0]])
            shared = np.concatenate([opening, follows])[:-1] | follows
            if len(key) > 1:
                yield give(key[:-1], doc[:-1], n[:-1], shared)
                before = key[-2]
            held = [key[-1:], doc[-1:], n[-1:]]
        if len(held[0]):
            yield give(*held, np.array([True]))

    return map_partitions(rows, run, "key long, id long, n long, leader long")


def promising(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose bitmaps allow the similarity."""
    sig = sets.select("id", "n", "sig").distinct()
    left, right = (sig.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}")) for c in "ab")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        na, sa, nb, sb = (batch.column(k).to_pylist() for k in range(2, 6))
        keep = [similar(most_shared(*x), x[0], x[2]) for x in zip(na, sa, nb, sb, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "sa", "nb", "sb")
    return map_batches(joined, run, "a long, b long")


def linked(pairs: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """The pairs ``a, b`` that are similar indeed, by intersecting their sorted shingles.

    A pair's texts meet at its home ``a``, in groups of about ``PARTNERS`` so that a home with very many
    partners spreads over tasks; a task holds the home's set and one other.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("groups"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("part"))
    sides = stored(
        dealt.select("a", "part", F.lit(0).alias("side"), F.col("a").alias("id")).distinct()
        .union(dealt.select("a", "part", F.lit(1), "b").distinct()), "sides",
    )
    met = in_filter(rows, "id", sides, "id", filter_bits(sides)).join(sides, "id").select("a", "part", "side", "id", "text")
    met = met.repartition("a", "part").sortWithinPartitions("a", "part", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, sets = None, []
        for batch in batches:
            a, b = [], []
            places = zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
            for (at, part, side, doc), text in zip(places, texts(batch.column(4)), strict=True):
                s = shingle_set(text, words)
                if (at, part) != home:
                    home, sets = (at, part), []
                if side == 0:
                    sets.append(s)  # several only where rows repeat an id
                elif any(len(s) and len(h) and similar(len(np.intersect1d(s, h, assume_unique=True)), len(s), len(h)) for h in sets):
                    a.append(at)
                    b.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return stored(map_partitions(met, run, "a long, b long").distinct(), "links")


class Tile:
    """The rows of a tile, sorted by size: any of them against all that are near it in size, by bitmaps."""

    def __init__(self, n: np.ndarray, sigs: list[bytes]):
        self.n, self.sigs = n, sigs
        self.low = np.searchsorted(DEN * n, NUM * n)  # the first and last row inside each row's size band
        if len(sigs) <= FEW:
            return
        self.high = np.searchsorted(NUM * n, DEN * n, side="right")
        widths = np.fromiter(map(len, sigs), np.int64, len(sigs))  # larger sets have no narrower bitmaps
        edges = [0, *(np.flatnonzero(widths[1:] != widths[:-1]) + 1).tolist(), len(sigs)]
        self.classes = []  # rows of one width: first, last, bitmaps, bitmaps folded to half the width
        for first, last in zip(edges[:-1], edges[1:], strict=True):
            wide = np.frombuffer(b"".join(sigs[first:last]), np.uint64).reshape(last - first, -1)
            half = wide.shape[1] // 2
            self.classes.append((first, last, wide, wide[:, :half] ^ wide[:, half:] if len(edges) > 2 else wide))

    def pairs(self, part: np.ndarray, group: np.ndarray | None) -> list[tuple[float, int, int]]:
        """The promising pairs of different components in a tile of few rows, and how alike they are."""
        found, n, part = [], self.n.tolist(), part.tolist()
        bits = [int.from_bytes(s, "little") for s in self.sigs]
        for i, start in enumerate(self.low.tolist()):
            for j in range(start, i):
                if part[i] != part[j] and (group is None or group[i] != group[j]):
                    shared = (n[i] + n[j] - differing(bits[i], len(self.sigs[i]), bits[j], len(self.sigs[j]))) // 2
                    if similar(shared, n[i], n[j]):
                        found.append((shared / (n[i] + n[j] - shared), j, i))
        return found

    def shared(self, i: int, start: int, end: int) -> np.ndarray:
        """The most shingles that row ``i`` shares with each of the rows from ``start`` to ``end`` of its band."""
        home = next(c for c in self.classes if c[0] <= i < c[1])
        differ = []
        for c in self.classes:
            first, last = max(start, c[0]), min(end, c[1])
            if first < last:  # widths in a band differ by a factor of two at most
                own = home[3] if c[0] < home[0] else home[2]
                others = c[3] if c[0] > home[0] else c[2]
                differ.append(np.bitwise_count(others[first - c[0] : last - c[0]] ^ own[i - home[0]]).sum(axis=1, dtype=np.int64))
        return (self.n[start:end] + self.n[i] - (np.concatenate(differ) if len(differ) > 1 else differ[0])) // 2

    def forest(self, part: np.ndarray, group: np.ndarray | None) -> list[tuple[int, int]]:
        """Pairs that tie the rows' components, most alike first: a spanning forest of the promising pairs, grown row by row.

        With ``group`` only rows of different groups are compared.
        """
        if len(part) <= FEW:
            return self.few_tied(part, group)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        members = {int(part[rows[0]]): rows.tolist() for rows in np.split(order, cuts)}
        best, via, pairs = np.full(len(part), -1.0), np.zeros(len(part), np.int64), []  # -1: not tied yet; -2: in the forest
        while best[j := int(best.argmax())] > -2:
            if best[j] >= 0:
                pairs.append((int(via[j]), j))
            rows = members.pop(int(part[j]))
            best[rows] = -2
            for i in rows if members else []:
                start, end = self.low[i], self.high[i]
                shared, both = self.shared(i, start, end), self.n[start:end] + self.n[i]
                like = np.where(DEN * shared >= NUM * (both - shared), shared / (both - shared), -1)
                if group is not None:
                    like[group[start:end] == group[i]] = -1
                now = best[start:end]
                nearer = (like > now) & (now > -2)
                now[nearer] = like[nearer]
                via[start:end][nearer] = i
        return pairs

    def few_tied(self, part: np.ndarray, group: np.ndarray | None) -> list[tuple[int, int]]:
        pairs, now = [], part.tolist()
        for _, j, i in sorted(self.pairs(part, group), key=lambda pair: -pair[0]):
            if now[i] != now[j]:
                old, new = now[i], now[j]
                now = [new if x == old else x for x in now]
                pairs.append((j, i))
        return pairs

    def complete(self, part: np.ndarray, group: np.ndarray | None, key: int, firsts) -> list[tuple[int, int]]:
        """All promising pairs of different components, but those that surely meet under an earlier key too."""
        pairs = []
        if len(part) <= FEW:
            for _, j, i in self.pairs(part, group):
                both = set(firsts[i]) & set(firsts[j])
                if not both or min(both) == key:
                    pairs.append((j, i))
            return pairs
        for i in range(1, len(part)):
            start = self.low[i]
            apart = part[start:i] != part[i]
            if group is not None:
                apart &= group[start:i] != group[i]
            if not apart.any():
                continue
            shared, both = self.shared(i, start, i), self.n[start:i] + self.n[i]
            rows = start + np.flatnonzero(apart & (DEN * shared >= NUM * (both - shared)))
            if len(rows):
                same = (firsts[rows][:, :, None] == firsts[i]).any(axis=2)
                meet = firsts[rows, same.argmax(axis=1)]
                pairs += [(j, i) for j in rows[~same.any(axis=1) | (meet == key)].tolist()]
        return pairs


def across(open_rows: DataFrame, sets: DataFrame, forest: bool) -> DataFrame:
    """Promising pairs of different components under one key: ``a, b``.

    ``open_rows`` has ``key, id, n, component``. A key's sets are dealt into groups of about ``TILE``, or fewer if their
    bitmaps are large; two groups make a tile, in which bitmaps are compared inside the size band, and between components only.
    With ``forest`` only neighbouring groups meet, and a tile gives the likeliest pair for each tie, so never more pairs
    than sets. Without it every two groups meet and all pairs are given, each under the first key that both its sets list.
    """
    many = open_rows.groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n") / TILE_SHINGLES)).alias("groups"))
    dealt = open_rows.join(many, "key").withColumn("g", F.pmod(F.xxhash64("id"), F.col("groups")))
    of_set = sets.select("id", "n", "sig").distinct()
    if not forest:
        place = F.row_number().over(Window.partitionBy("id", "n").orderBy("key"))
        listed = open_rows.withColumn("place", place).where(F.col("place") <= FIRSTS)
        listed = listed.groupBy("id", "n").agg(F.sort_array(F.collect_list("key")).alias("firsts"))
        of_set = of_set.join(listed, ["id", "n"])
    dealt = dealt.join(of_set, ["id", "n"])
    last = F.col("groups") - 1
    others = F.sequence(F.greatest(F.col("g") - 1, F.lit(0)), F.least(F.col("g") + 1, last)) if forest else F.sequence(F.lit(0).cast("long"), last)
    tiles = dealt.withColumn("h", F.explode(others)).select(
        "key", F.least("g", "h").alias("lo"), F.greatest("g", "h").alias("hi"), "n", "id", "component", "g", "sig", *([] if forest else ["firsts"])
    )
    tiles = tiles.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "n", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(rows: list, start: int, end: int) -> tuple[list[int], list[int]]:
            key, lo, hi, n, ids, part, group = (c[start:end] for c in rows[:7])
            if (part == part[0]).all():
                return [], []
            tile, group = Tile(n, rows[7][start:end]), group if lo[0] != hi[0] else None
            if forest:
                found = tile.forest(part, group)
            else:
                firsts = rows[8][start:end]
                if len(firsts) > FEW:
                    firsts = np.array([(f + f[-1:] * FIRSTS)[:FIRSTS] for f in firsts])
                found = tile.complete(part, group, key[0], firsts)
            return [int(ids[min(p)]) for p in found], [int(ids[max(p)]) for p in found]

        held = None  # columns of the tile that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy() for c in batch.columns[:7]] + [c.to_pylist() for c in batch.columns[7:]]
            if held:
                rows = [np.concatenate([h, c]) if isinstance(c, np.ndarray) else h + c for h, c in zip(held, rows, strict=True)]
            new = np.any([c[1:] != c[:-1] for c in rows[:3]], axis=0)
            edges = [0, *(np.flatnonzero(new) + 1).tolist()]
            found = [pairs(rows, *x) for x in zip(edges[:-1], edges[1:], strict=True)]
            held = [c[edges[-1] :] for c in rows]
            yield pa.RecordBatch.from_arrays([pa.array([x for f in found for x in f[k]], pa.int64()) for k in range(2)], ["a", "b"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs(held, 0, len(held[0]))], ["a", "b"])

    return stored(map_partitions(tiles, run, "a long, b long").distinct(), "across")


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """``id, component`` after ``links``: only components that a link ties are looked at again."""
    ids = links.select(F.col("a").alias("id")).union(links.select("b")).distinct().join(label, "id", "left_anti")
    label = stored(label.unionByName(ids.select("id", F.col("id").alias("component"))), "labels")
    left, right = (label.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
    ties = links.join(left, "a").join(right, "b").select("ca", "cb").where("ca <> cb").distinct()
    found = components(ties, "ca", "cb").select(F.col("id").alias("component"), F.col("component").alias("now"))
    return stored(label.join(found, "component", "left").select("id", F.coalesce("now", "component").alias("component")), "labels")


def near_components(df: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``: per row the size of its set and the smallest id that links reach.

    Two sets link when 4 times their intersection is at least 3 times their union. Links are complete:

    1. Equal sets are one class, represented by its smallest id; only representatives go on.
    2. Similar sets share a key. Under each key a size band has a leader; each set is first tried against its most
       frequent leader: bitmaps bound the overlap from above, exact intersection confirms it.
    3. Links inside a component change nothing. Wherever sets that share keys are still in several components, sets
       of different components are compared in size-banded tiles of bitmaps: first for one pair per tie, and
       then completely. Survivors are confirmed.

    So a family of copies costs a comparison per member, not per pair, and no partner is capped.

    A text without words (or null) has an empty set: size 0, linked with nothing. Rows that repeat an id are texts of one document:
    their links are united. A null id counts as one document after all others. An empty table gives an empty
    one; other columns are not read.
    """
    rows = keyed(df, id_col, text_col)
    seen = stored(profiles(rows, words), "profiles")
    docs = seen.where(F.col("digest").isNotNull()).select("id", "n", "digest")
    often = seen.where(F.col("mer").isNotNull()).groupBy("mer").agg(F.sum("seen").alias("seen"))
    common = often.orderBy(F.desc("seen"), "mer").limit(COMMON).select("mer").toArrow().column("mer").to_numpy()
    classes = docs.where("n > 0").groupBy("digest").agg(F.min("id").alias("id"))
    order = np.sort(common.astype(np.int64).view(np.uint64))
    sets = stored(indexed(rows, order, words).join(classes, ["digest", "id"], "left_semi").drop("digest"), "sets")
    keyed_rows = stored(runs(sets), "keys")

    members = docs.where("n > 0").join(classes.withColumnRenamed("id", "rep"), "digest").select("id", "rep", "n")
    several = members.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("id", "a")
    same_id = members.join(several, "id").select("a", F.col("rep").alias("b")).where("a <> b").distinct()

    # any choice of leader is right here, as the next step looks at whatever stays apart; the most frequent one is most alike
    led = keyed_rows.where("leader <> id").groupBy("id", "leader").agg(F.count(F.lit(1)).alias("many"))
    led = led.groupBy("id").agg(F.max(F.struct("many", "leader")).alias("best")).select(F.col("best.leader").alias("a"), F.col("id").alias("b"))
    best = promising(led, sets).select("a", "b")
    first = linked(stored(best, "led"), rows, words).union(same_id)

    label = stored(components(first, "a", "b"), "labels")
    for forest in (True, False):
        held = keyed_rows.select("key", "id", "n").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
        held = stored(held.distinct(), "held")
        # an id with texts of several sizes has a row for each; with the size in it no two rows of a key cancel
        seal = [F.bit_xor(F.xxhash64("id", "n", F.lit(k))).alias(f"seal{k}") for k in range(2)]
        mixed = held.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("many"), *seal)
        # keys with the very same sets compare the same pairs, so one of them does
        mixed = mixed.where("x < y").groupBy("many", "seal0", "seal1").agg(F.min("key").alias("key")).select("key")
        open_rows = stored(held.join(mixed, "key"), "open")
        label = merged(label, linked(across(open_rows, sets, forest), rows, words))

    label = label.withColumnRenamed("id", "rep")
    named = docs.join(classes.withColumnRenamed("id", "rep"), "digest", "left").join(label, "rep", "left")
    return named.select(id_back("id").alias("doc_id"), F.col("n").alias("n_shingles"), id_back(F.coalesce("component", "rep", "id")).alias("component_id"))


