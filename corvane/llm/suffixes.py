"""Byte spans repeated anywhere in a corpus: suffix arrays per shard, merged across shards where a shard is not enough.

Every window of ``window`` bytes is assigned to the least hashed ``MER`` bytes in it, its anchor; windows in a row with
one anchor are a piece. Equal windows have equal anchors, so a window can only repeat where its anchor does, and only
pieces of repeated anchors go on. Pieces of one anchor that are equal throughout repeat as a whole. The others,
one of each kind, meet in shards by anchor, and a suffix array of the shard's bytes finds the windows that repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import id_back, in_filter, keyed, map_batches, map_partitions, mix64, stored, texts
from corvane.llm.shingles import powers, rolling, sliding

WINDOW = 200
MER = 32
STARTS = 1 << 18  # windows of a text that are looked at together
SHARD_BYTES = 1 << 21  # of text in a suffix array, which takes some 60 bytes for each
KINDS = 4096  # different pieces of one anchor in one shard; an anchor with more has several
BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
OTHER_CODES = mix64(np.arange(1001, 1257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


# --- pieces ---------------------------------------------------------------------------------------------------------


def pieces_of(data: np.ndarray, window: int, mer: int) -> tuple[np.ndarray, ...]:
    """``start, many, anchor, tied``: the pieces of a text, which take every window once.

    Among equal least mers the one at the smallest place modulo the width of the choice is taken, so that a text
    of one letter has no more anchors than another. ``tied`` marks anchors that occur twice close together: windows
    of one piece may then equal each other.
    """
    width = window - mer + 1
    found = []
    for begin in range(0, max(0, len(data) - window + 1), STARTS):
        part = data[begin : begin + STARTS + window - 1]
        hashes = rolling(BYTE_CODES[part], mer) >> np.uint64(8)
        place = np.resize(np.arange(width, dtype=np.uint64), len(hashes))
        least = sliding((hashes << np.uint64(8)) | place, width, np.minimum)
        first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        many = np.diff(np.append(first, len(least)))
        again = -(-many // width)  # a run of one letter keeps its anchor's key, not the anchor
        nth = np.arange(int(again.sum())) - np.repeat(np.cumsum(again) - again, again)
        first, many = np.repeat(first, again) + nth * width, np.minimum(np.repeat(many, again) - nth * width, width)
        anchor = least[first] >> np.uint64(8)
        marks = np.zeros(1 << 20, dtype=bool)
        marks[anchor & np.uint64((1 << 20) - 1)] = True
        at = np.flatnonzero(marks[hashes & np.uint64((1 << 20) - 1)])
        order = at[np.argsort(hashes[at], kind="stable")]
        close = (hashes[order[1:]] == hashes[order[:-1]]) & (order[1:] - order[:-1] < 2 * width)
        found.append((first + begin, many, anchor.view(np.int64), np.isin(anchor, hashes[order[1:]][close])))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, bool))


def pieces(rows: DataFrame, window: int, mer: int) -> DataFrame:
    """``id, tag, start, many, anchor, digest, tied`` of all texts; the digest is of the bytes of all the piece's windows."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for doc, text, tag in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            start, many, anchor, tied = pieces_of(np.frombuffer(text, dtype=np.uint8), window, mer)
            if not len(start):
                continue
            digests = [xxhash.xxh3_64_intdigest(text[s : s + n + window - 1]) for s, n in zip(start.tolist(), many.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(start), doc, np.int64)), pa.array(np.full(len(start), tag, np.int64)), pa.array(start.astype(np.int32)),
                    pa.array(many.astype(np.int32)), pa.array(anchor), pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array(tied),
                ],
                ["id", "tag", "start", "many", "anchor", "digest", "tied"],
            )

    return map_batches(rows.select("id", "text", "tag"), run, "id long, tag long, start int, many int, anchor long, digest long, tied boolean")


# --- suffix arrays --------------------------------------------------------------------------------------------------


def leading(data: np.ndarray) -> np.ndarray:
    """The next eight bytes at every place as one number; zeros stand after the end."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    out = np.zeros(len(data), dtype=np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(data)]
    return out


def suffix_array(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes and each one's place in it, by Larsson and Sadakane's refinement.

    Suffixes begin grouped by their ``first`` eight bytes. Every round doubles the depth: only groups that are still
    larger than one are sorted, by the group of the suffix that starts a depth later.
    """
    n = len(data)
    # suffixes of fewer than eight bytes are alone in their groups, the shorter before the longer and before all others
    whole = max(0, n - 7)
    turn = np.concatenate([np.arange(n - 1, whole - 1, -1), np.arange(whole)])
    order = turn[np.argsort(first[turn], kind="stable")]
    short = order >= whole
    new = np.concatenate([[True], (first[order][1:] != first[order][:-1]) | short[1:] | short[:-1]]) if n else np.empty(0, bool)
    group = np.empty(n, dtype=np.int64)
    group[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    depth = 8
    open_at = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in the order that share a group
    while len(open_at):
        held = order[open_at]
        later = held + depth
        key = (group[held] << 32) | np.where(later < n, group[np.minimum(later, n - 1)] + 1, 0)
        sort = np.argsort(key, kind="stable")
        held, key = held[sort], key[sort]
        order[open_at] = held
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        group[held] = open_at[np.maximum.accumulate(np.where(fresh, np.arange(len(held)), 0))]
        open_at = open_at[~(fresh & np.append(fresh[1:], True))]
        depth *= 2
    return order, group


def common_prefixes(data: np.ndarray, first: np.ndarray, order: np.ndarray, place: np.ndarray, begin: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """Per suffix the bytes it shares with its predecessor in the order, ``most`` at most, by Kasai's rule.

    A suffix shares at most one byte less than the one that starts a byte earlier. All pieces are walked side by
    side, each from its begin on.
    """
    n = len(data)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, dtype=np.int64)
    by_size = np.argsort(-size, kind="stable")
    begin, size = begin[by_size], size[by_size]
    held = np.zeros(len(begin), dtype=np.int64)
    active = len(begin)
    for step in range(int(size[0]) if len(size) else 0):
        while size[active - 1] <= step:
            active -= 1
        at = begin[:active] + step
        other = before[at]
        have = np.maximum(held[:active] - 1, 0)
        have[other < 0] = 0
        going = np.flatnonzero(other >= 0)
        while len(going):
            a, b = at[going] + have[going], other[going] + have[going]
            inside = (a < n) & (b < n) & (have[going] < most)
            going, a, b = going[inside], a[inside], b[inside]
            differ = first[a] ^ first[b]
            equal = np.zeros(len(going), dtype=np.int64)
            for k in range(1, 9):
                equal += differ < np.uint64(1 << (64 - 8 * k)) if k < 8 else differ == 0
            have[going] += np.minimum(equal, n - np.maximum(a, b))
            going = going[equal == 8]
        held[:active] = np.minimum(have, most)
        shared[at] = held[:active]
    return shared


def repeated_starts(data: np.ndarray, begin: np.ndarray, many: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all windows of the pieces laid end to end, and for each the first of its equals in the suffix order."""
    first = leading(data)
    order, place = suffix_array(data, first)
    size = many + window - 1
    shared = common_prefixes(data, first, order, place, begin, size, window)
    is_start = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(is_start, begin, 1)
    np.add.at(is_start, begin + many, -1)
    starts = np.flatnonzero(np.cumsum(is_start)[:-1])
    inside = np.zeros(len(data), dtype=bool)
    inside[starts] = True
    ranked = np.flatnonzero(inside[order])  # in suffix order
    least = np.minimum.reduceat(shared[order], ranked[:-1] + 1) if len(ranked) > 1 else np.empty(0, np.int64)
    if len(ranked) > 1:
        # reduceat goes on to the end for the last bound: only up to the last start counts there
        least[-1] = shared[order[ranked[-2] + 1 : ranked[-1] + 1]].min()
    head = np.concatenate([[True], least < window]) if len(ranked) else np.empty(0, bool)
    sorted_starts = order[ranked]
    leader = np.empty(len(data), dtype=np.int64)
    leader[sorted_starts] = sorted_starts[np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))] if len(head) else sorted_starts
    return starts, leader[starts]


def window_codes(data: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the windows at ``starts``."""
    up, down = powers(len(data))
    out = []
    for codes in (BYTE_CODES, OTHER_CODES):
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(codes[data] * up, dtype=np.uint64)])
        out.append(mix64((sums[starts + window] - sums[starts]) * down[starts]))
    return out[0], out[1]


# --- shards ---------------------------------------------------------------------------------------------------------


def packed(columns: list[np.ndarray]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.stack([c.astype("<i8", copy=False) if c.dtype != np.uint64 else c.view("<i8") for c in columns]).tobytes())


def unpacked(blob: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype="<i8").reshape(columns, -1)


def searched(shards: DataFrame, window: int) -> DataFrame:
    """``id, tag, start, end`` of windows in a row that repeat in their shard, and ``anchor, slice, codes`` of those that
    another shard of the same anchor may have.

    ``shards`` has ``home, anchor, slices, alone, id, tag, start, many, bytes``. A shard is walked in suffix arrays
    of ``SHARD_BYTES`` at most; pieces of an anchor stay together but for anchors with several shards.
    """
    schema = "id long, tag long, start int, end int, anchor long, slice long, codes binary"
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in schema.split(", ")]

    def solve(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        anchor, slices, alone, doc, tag, start, many = (np.array(c) for c in zip(*(h[:7] for h in held), strict=True))
        raw = b"".join(h[7] for h in held)
        data = np.frombuffer(raw, dtype=np.uint8)
        size = many + window - 1
        begin = np.cumsum(size) - size
        starts, leader = repeated_starts(data, begin, many, window)
        piece = np.searchsorted(begin, starts, side="right") - 1
        share = np.bincount(leader, minlength=len(data))[leader]
        hit = (share > 1) & alone[piece]
        text_at = start[piece] + starts - begin[piece]
        # windows in a row in one piece are one span
        p, s = piece[hit], text_at[hit]
        if len(p):
            new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)]))
            last = np.append(new[1:], len(p)) - 1
            columns = [doc[p[new]], tag[p[new]], s[new], s[last] + window, None, None, None]
            yield table(columns, len(new))
        for a in np.unique(anchor[slices > 1]):
            # one of each kind of window, whether it is still alone here
            mine = np.flatnonzero((anchor[piece] == a) & (leader == starts))
            codes = window_codes(data, starts[mine], window)
            waiting = (share[mine] == 1) & alone[piece[mine]]
            order = np.argsort(codes[0], kind="stable")
            mine, waiting = mine[order], waiting[order]
            columns = [codes[0][order], codes[1][order], waiting.astype(np.int64), doc[piece[mine]], tag[piece[mine]], text_at[mine]]
            many_slices = int(slices[anchor == a][0])
            # cut where the slices begin, by binary search
            bounds = (np.arange(many_slices + 1, dtype=object) * (1 << 64) // many_slices)[1:-1].astype(np.uint64)
            cuts = [0, *np.searchsorted(columns[0], bounds).tolist(), len(mine)]
            for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if x < y:
                    yield table([None, None, None, None, [int(a)], [k], [packed([c[x:y] for c in columns])]], 1)

    def table(columns: list, many: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(many, k) if c is None else pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, held, size = None, [], 0
        for batch in batches:
            for at, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # a full array may end before the next anchor of its shard
                if held and (at != home or (size >= SHARD_BYTES and rest[0] != held[-1][0])):
                    yield from solve(held)
                    held, size = [], 0
                home = at
                held.append(tuple(rest))
                size += len(rest[7])
        if held:
            yield from solve(held)

    asked = shards.select("home", "anchor", "slices", "alone", "id", "tag", "start", "many", "bytes")
    return map_partitions(asked.repartition("home").sortWithinPartitions("home", "anchor"), run, schema)


def across(slices: DataFrame) -> DataFrame:
    """``id, tag, start``: windows that another shard of their anchor has too.

    The sorted lists of a slice are merged two at a time, each looked up in the other by binary search.
    """

    def join(x: np.ndarray, y: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
        """Two sorted lists as one, of which no code is alone any more if both have it."""
        at = np.minimum(np.searchsorted(x[0].view(np.uint64), y[0].view(np.uint64)), x.shape[1] - 1)
        same = (x[0][at] == y[0]) & (x[1][at] == y[1])
        for side, which in ((x, at[same]), (y, np.flatnonzero(same))):
            found.append(side[3:, which[side[2, which] == 1]])
            side[2, which] = 0
        rest = y[:, ~same]
        place = np.searchsorted(x[0].view(np.uint64), rest[0].view(np.uint64))
        return np.insert(x, place, rest, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stack = None, []

        def out(found: list[np.ndarray]) -> pa.RecordBatch:
            doc, tag, start = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tag), pa.array(start.astype(np.int32))], ["id", "tag", "start"])

        for batch in batches:
            found: list[np.ndarray] = []
            for anchor, at, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (anchor, at):
                    while len(stack) > 1:
                        stack.append((0, join(stack.pop()[1], stack.pop()[1], found)))
                    key, stack = (anchor, at), []
                stack.append((1, unpacked(blob, 6).copy()))
                while len(stack) > 1 and stack[-1][0] == stack[-2][0]:  # lists of like weight
                    weight = stack[-1][0] * 2
                    stack.append((weight, join(stack.pop()[1], stack.pop()[1], found)))
            yield out(found)
        found = []
        while len(stack) > 1:
            stack.append((0, join(stack.pop()[1], stack.pop()[1], found)))
        yield out(found)

    dealt = slices.select("anchor", "slice", "codes").repartition("anchor", "slice").sortWithinPartitions("anchor", "slice")
    return map_partitions(dealt, run, "id long, tag long, start int")


# --- the operator ---------------------------------------------------------------------------------------------------


def repeated(rows: DataFrame, window: int, mer: int) -> DataFrame:
    """``id, tag, start, end``: spans of bytes covered by windows that repeat. ``rows`` has ``id, text, tag``."""
    table = stored(pieces(rows, window, mer), "pieces")
    anchors = table.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("digest").alias("x"), F.max("digest").alias("y"), F.max("tied").alias("tied")
    ).where("n > 1 or tied").select("anchor", F.expr("n > 1 and x = y").alias("whole"))
    seen = stored(table.join(stored(anchors, "anchors"), "anchor"), "repeated")
    mixed = seen.where(~F.col("whole"))
    some = F.min(F.struct("id", "tag", "start", "many")).alias("some")
    kinds = stored(mixed.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n"), some), "kinds")
    span = [F.col("id"), F.col("tag"), F.col("start"), (F.col("start") + F.col("many") + (window - 1)).alias("end")]
    twice = kinds.where("n > 1").select("anchor", "digest")
    spans = seen.where("whole").select(*span).union(mixed.join(twice, ["anchor", "digest"], "left_semi").select(*span))

    per = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    # a shard of its own for every KINDS pieces of an anchor; where no piece is alone there is nothing to find
    per = per.where("least = 1").select("anchor", F.ceil(F.col("kinds") / KINDS).cast("int").alias("slices"))
    chosen = kinds.join(stored(per, "shards"), "anchor").select("anchor", "digest", "slices", (F.col("n") == 1).alias("alone"), "some.*")
    size = chosen.agg(F.sum(F.col("many") + F.lit(window - 1))).first()[0] or 0
    shards = -(-size // SHARD_BYTES) or 1
    home = F.when(F.col("slices") == 1, F.pmod(F.xxhash64("anchor"), F.lit(shards))).otherwise(
        F.xxhash64("anchor", F.pmod(F.col("digest"), F.col("slices"))).bitwiseOR(F.lit(-(2**63)).cast("long"))
    )
    asked = stored(
        chosen.withColumn("home", home).groupBy("id", "tag").agg(F.collect_set(F.struct("home", "anchor", "slices", "alone", "start", "many")).alias("asked")),
        "asked",
    )
    met = in_filter(rows, "tag", asked, "tag").join(asked, ["id", "tag"]).select("id", "tag", "text", "asked")
    found = stored(searched(cut_out(met, window), window), "searched")
    others = across(found.where(F.col("codes").isNotNull()))
    inner = found.where(F.col("codes").isNull()).select("id", "tag", "start", "end")
    return spans.union(inner).union(others.select("id", "tag", "start", (F.col("start") + window).alias("end")))


def cut_out(met: DataFrame, window: int) -> DataFrame:
    """The bytes of the asked pieces of every text."""
    schema = "home long, anchor long, slices int, alone boolean, id long, tag long, start int, many int, bytes binary"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for doc, tag, text, asked in zip(*(batch.column(k).to_pylist() for k in (0, 1)), texts(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            for p in asked:
                s, n = p["start"], p["many"]
                out.append((p["home"], p["anchor"], p["slices"], p["alone"], doc, tag, s, n, text[s : s + n + window - 1]))
        columns = zip(*out, strict=True) if out else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names)

    return map_batches(met, run, schema)


def dedup_bytes(df: DataFrame, window: int = WINDOW, mer: int = MER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept``: every row without the bytes of windows that start anywhere else too.

    Texts are UTF-8 bytes and windows do not cross them; a window may repeat in its own text and overlap itself. All
    of its places lose it, the first too. Spans are the runs of removed bytes, ``kept`` is what is left, which need
    not be valid UTF-8.

    A null or empty text has no bytes. Repeated rows are places like any others, so both lose what they share.
    A null id is an id of its own; an empty table gives an empty one; other columns are not read. The tag
    of a text is a 64-bit hash: rows of one id whose texts differ are told apart by it.
    """
    if not mer <= window < mer + 256:
        raise ValueError("a window must hold a mer, with fewer than 256 bytes to choose from")
    rows = keyed(df, id_col, text_col).withColumn("tag", F.xxhash64("text"))
    spans = repeated(rows, window, mer)
    lost = stored(spans.groupBy("id", "tag").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "lost")
    hit = in_filter(rows, "tag", lost, "tag").join(lost, ["id", "tag"], "left").select("id", "text", "spans")
    miss = in_filter(rows, "tag", lost, "tag", keep=False).select("id", "text", F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts, kept = [], []
        offsets = batch.column(2).offsets.to_numpy()
        starts, ends = (batch.column(2).values.field(k).to_numpy() for k in (0, 1))
        for k, text in enumerate(texts(batch.column(1))):
            s, e = starts[offsets[k] : offsets[k + 1]], ends[offsets[k] : offsets[k + 1]]
            edges = np.bincount(s, minlength=len(text) + 1) - np.bincount(e, minlength=len(text) + 1)
            gone = np.cumsum(edges)[:-1] > 0
            first = np.count_nonzero(gone[1:] & ~gone[:-1]) + int(len(gone) > 0 and gone[0])
            counts.append((len(text), int(gone.sum()), first))
            kept.append(np.frombuffer(text, dtype=np.uint8)[~gone].tobytes() if len(s) else text)
        sizes = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)] if counts else [pa.array([], pa.int64())] * 3
        yield pa.RecordBatch.from_arrays([batch.column(0), *sizes, pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = map_batches(hit.unionByName(miss), run, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(id_back("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
