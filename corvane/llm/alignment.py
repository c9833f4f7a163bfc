"""Alignment of two tokenizers' ids over a corpus, with pair counts by external spill counting.

Every task cuts its documents into runs. A run's records (B id, A id, document, links) are sorted side-major, B ids
first, dealt by the low digits of the B id (the radix) and packed as zstd runs. Runs of one radix are merged by a heap,
at most ``FAN`` at a time, until one count per pair is left; as that stream comes in B order, the largest count of every
B id is known when the id ends. Then each run's records stream past the counts of their radix, and what a
document gets from them is added up per run.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import id_back, keyed, map_batches, map_partitions, stored
from corvane.llm.packing import PLAIN
from corvane.llm.tokens import PART_CHARS, encoding, parts

RADIX = 64  # parts that B ids are dealt to
RUN_LINKS = 1 << 21  # links of a run: 16 MB before packing
RUN_DOCS = 1 << 20  # documents of a run
FAN = 64  # runs that are merged at a time
BLOCK = 1 << 14  # entries of a packed block: what a merge holds of one run
CHUNK_CHARS = 1 << 20  # characters whose tokens are Python objects at the same time
SPACE = "▁"
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
DOC_COLUMNS = "id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


# --- the two tokenizers ---------------------------------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@functools.lru_cache(maxsize=2)
def a_bytes(vocabulary: str) -> list[bytes]:
    with open(vocabulary, encoding="utf-8") as file:
        content = json.load(file)
    letters = byte_letters()
    entries = {i: bytes(letters[c] for c in entry) for entry, i in content["model"]["vocab"].items() if all(c in letters for c in entry)}
    entries |= {t["id"]: t["content"].encode() for t in content["added_tokens"]}
    return [entries.get(i, b"") for i in range(max(entries) + 1)]


@functools.lru_cache(maxsize=2)
def a_tokenizer(vocabulary: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(vocabulary)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    return found


def a_ids(some: list[str], vocabulary: str, ranks: tuple[str, str] | None) -> list[list[int]]:
    """Ids of whole texts. ``ranks``, a rank file of the same vocabulary and its pattern, is the faster way to the same
    ids for texts of characters that both ways split alike; every other text goes through ``vocabulary``."""
    quick = [bool(ranks) and PLAIN.fullmatch(t) is not None for t in some]
    others = iter(a_tokenizer(vocabulary).encode_batch_fast([t for t, ok in zip(some, quick, strict=True) if not ok], add_special_tokens=False) if not all(quick) else [])
    fast = encoding(*ranks) if ranks else None
    return [[i for part in parts(t) for i in fast.encode_ordinary(part)] if ok else next(others).ids for t, ok in zip(some, quick, strict=True)]


@functools.lru_cache(maxsize=2)
def b_tokenizer(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


@functools.lru_cache(maxsize=2)
def b_bytes(model: str) -> list[bytes]:
    known = b_tokenizer(model)
    pieces = [known.id_to_piece(i) for i in range(known.get_piece_size())]
    return [bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace(SPACE, " ").encode() for p in pieces]


@functools.lru_cache(maxsize=2)
def b_cuts(model: str) -> re.Pattern | None:
    """Where a long text may be cut: before a blank after another character, if no piece has a blank after one."""
    known = b_tokenizer(model)
    inner = any(SPACE in known.id_to_piece(i).lstrip(SPACE) for i in range(known.get_piece_size()))
    return None if inner else re.compile(f"(?<=[^ {SPACE}])(?= )")


def b_ids(some: list[str], model: str) -> list[list[int]]:
    """Ids of whole texts; a part after a cut gives its blank to the one that the tokenizer adds."""
    cuts, cut_texts, owners = b_cuts(model), [], []
    for k, text in enumerate(some):
        start = 0
        while cuts and len(text) - start > PART_CHARS and (found := cuts.search(text, start + PART_CHARS)):
            cut_texts.append(text[start : found.start()])
            owners.append(k)
            start = found.start() + 1
        cut_texts.append(text[start:])
        owners.append(k)
    out: list[list[int]] = [[] for _ in some]
    for k, ids in zip(owners, b_tokenizer(model).encode(cut_texts, num_threads=1), strict=True):
        out[k] = out[k] + ids if out[k] else ids
    return out


# --- packed arrays --------------------------------------------------------------------------------------------------


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as blocks of ``BLOCK`` entries: bytes of equal weight stand together, then zstd."""
    squeeze, out = zstandard.ZstdCompressor(level=1), []
    for start in range(0, len(columns[0]), BLOCK):
        raw = b"".join(np.ascontiguousarray(c[start : start + BLOCK], dtype="<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
        frame = squeeze.compress(raw)
        out += [len(frame).to_bytes(4, "little"), frame]
    return b"".join(out)


def blocks(blob: bytes, columns: int) -> Iterator[list[np.ndarray]]:
    """The blocks of ``pack``, one at a time."""
    at, open_up = 0, zstandard.ZstdDecompressor()
    while at < len(blob):
        size = int.from_bytes(blob[at : at + 4], "little")
        raw = np.frombuffer(open_up.decompress(blob[at + 4 : at + 4 + size]), dtype=np.uint8).reshape(columns, 8, -1)
        yield [np.ascontiguousarray(c.T).view("<u8").ravel() for c in raw]
        at += 4 + size


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    found = list(blocks(blob, columns))
    return [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.uint64)] * columns


# --- runs -----------------------------------------------------------------------------------------------------------


class Layout:
    """How a pair is one number: radix of the B id, rest of the B id, A id; and a record: pair, place of the document."""

    def __init__(self, a_size: int, b_size: int):
        self.a_bits = max(1, (a_size - 1).bit_length())
        self.rest_bits = max(1, ((b_size - 1) // RADIX).bit_length())
        self.doc_bits = (RUN_DOCS - 1).bit_length()
        if (RADIX - 1).bit_length() + self.rest_bits + self.a_bits + self.doc_bits > 64:
            raise ValueError("the vocabularies are too large for one 64-bit record")

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        high = ((b % RADIX) << self.rest_bits) | (b // RADIX)
        return (high << self.a_bits) | a

    def bounds(self) -> np.ndarray:
        """The least pair of each radix, and the end."""
        return np.arange(RADIX + 1, dtype=np.uint64) << np.uint64(self.rest_bits + self.a_bits)

    def b_of(self, pair: np.ndarray) -> np.ndarray:
        return pair >> np.uint64(self.a_bits)


def aligned(a: list[list[int]], b: list[list[int]], a_size: np.ndarray, b_size: np.ndarray, names: list[str], layout: Layout):
    """Of texts that both tokenizers tile: n_groups, n_links and group texts' hashes, and per link its text and pair.

    All texts are laid end to end. A link is a stretch between neighbouring ends of either side; a group ends where both do.
    """
    flat = [np.fromiter((i for x in side for i in x), np.int64) for side in (a, b)]
    sizes = [np.array([len(x) for x in side]) for side in (a, b)]
    ends = [np.cumsum(size[ids]) for size, ids in zip((a_size, b_size), flat, strict=True)]
    cuts = np.union1d(*ends)
    at = [np.searchsorted(e, cuts) for e in ends]
    owner = np.repeat(np.arange(len(a)), sizes[0])
    links = owner[at[0]]
    last = [ends[1 - s][np.searchsorted(ends[1 - s], ends[s])] == ends[s] for s in (0, 1)]
    group = [np.cumsum(x) - x for x in last]
    total = int(last[0].sum())
    many = [np.bincount(g, minlength=total) for g in group]
    # a group's A tokens come before its B tokens, after all of the groups before
    codes = np.empty(len(flat[0]) + len(flat[1]), dtype=np.int64)
    codes[np.arange(len(flat[0])) + (np.cumsum(many[1]) - many[1])[group[0]]] = 2 * flat[0] + last[0]
    codes[np.arange(len(flat[1])) + np.cumsum(many[0])[group[1]]] = 2 * (len(a_size) + flat[1]) + last[1]
    begin = np.concatenate([[0], np.cumsum(sizes[0] + sizes[1])]).tolist()
    spelt = [hashlib.sha256("".join(map(names.__getitem__, codes[s:e].tolist()))[:-1].encode()).hexdigest() for s, e in zip(begin, begin[1:], strict=False)]
    pairs = layout.pair(flat[0][at[0]], flat[1][at[1]]).astype(np.uint64)
    return np.bincount(owner[last[0]], minlength=len(a)), np.bincount(links, minlength=len(a)), spelt, links, pairs


def spill(rows: DataFrame, vocabulary: str, ranks: tuple[str, str] | None, model: str) -> DataFrame:
    """Rows of two kinds: ``run, slot`` with what is known of a document, and ``run, radix`` with packed records and pairs."""
    schema = f"run long, slot int, {DOC_COLUMNS}, radix int, records binary, pairs binary"
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.int32(), pa.binary(), pa.binary()]
    names = [c.split()[0] for c in schema.split(", ")]

    def table(columns: list, many: int) -> pa.RecordBatch:
        full = [pa.array(c if c is not None else repeat(None, many), type=k, size=many) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(full, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelt = a_bytes(vocabulary), b_bytes(model)
        layout = Layout(*map(len, spelt))
        sizes = [np.array([len(x) for x in side], dtype=np.int64) for side in spelt]
        tails = [f"{i}{end}" for side, ends in zip(spelt, ((",", "|"), (",", ";")), strict=True) for i in range(len(side)) for end in ends]
        number = (TaskContext.get().partitionId() << 32) if TaskContext.get() else 0
        held: list[np.ndarray] = []
        links = docs = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, links, docs, number
            records, many = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            pair = records >> np.uint64(layout.doc_bits)
            cuts = np.searchsorted(pair, layout.bounds()).tolist()
            for radix, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if s < e:
                    firsts = np.flatnonzero(np.concatenate([[True], pair[s + 1 : e] != pair[s : e - 1]]))
                    packed = pack(np.diff(records[s:e], prepend=np.uint64(0)), many[s:e])
                    counts = pack(pair[s:e][firsts], np.add.reduceat(many[s:e], firsts))
                    yield table([[number], None, None, None, None, None, None, None, [radix], [packed], [counts]], 1)
            held, links, docs = [], 0, 0
            number += 1

        for batch in batches:
            for ids, some in chunks(batch):
                lead = [f" {t}" for t in some]
                full = [k for k, t in enumerate(some) if t]
                found = [a_ids([lead[k] for k in full], vocabulary, ranks), b_ids([some[k] for k in full], model)]
                good = [
                    j for j, k in enumerate(full)
                    if all(b"".join(map(side.__getitem__, ids_of[j])) == lead[k].encode() for side, ids_of in zip(spelt, found, strict=True))
                ]
                n = np.zeros((4, len(some)), dtype=np.int64)
                shas = [""] * len(some)
                if good:
                    at = np.array([full[j] for j in good])
                    a, b = ([side[j] for j in good] for side in found)
                    n[0, at], n[1, at] = [len(x) for x in a], [len(x) for x in b]
                    n[2, at], n[3, at], named, owner, pairs = aligned(a, b, *sizes, tails, layout)
                    for k, sha in zip(at.tolist(), named, strict=True):
                        shas[k] = sha
                    held.append((pairs << np.uint64(layout.doc_bits)) | (at[owner] + docs).astype(np.uint64))
                    links += len(pairs)
                yield table([[number] * len(some), range(docs, docs + len(some)), ids, *n, shas, None, None, None], len(some))
                docs += len(some)
                if links >= RUN_LINKS or docs > RUN_DOCS - 2 * len(some) - 1024:
                    yield from flush()
        if docs:
            yield from flush()

    return map_partitions(rows, run, schema)


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[str]]]:
    """The ids and texts of a batch in pieces of about ``CHUNK_CHARS`` characters, one text at least."""
    ids, some, size = [], [], 0
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        ids.append(doc)
        some.append(text or "")
        size += len(some[-1])
        if size >= CHUNK_CHARS:
            yield ids, some
            ids, some, size = [], [], 0
    if ids:
        yield ids, some


# --- merging --------------------------------------------------------------------------------------------------------


def merge(blobs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs in order with their counts added up, from packed runs of which one block each is open.

    The heap gives the run whose open block ends first. Up to that end every run's open block is complete, so all
    entries up to there are taken from all of them, and the runs whose blocks are used up open the next one.
    """
    feeds = [blocks(b, 2) for b in blobs]
    open_blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def advance(k: int) -> None:
        block = next(feeds[k], None)
        open_blocks.pop(k, None)
        if block is not None:
            open_blocks[k] = (block[0], block[1])
            heapq.heappush(heap, (int(block[0][-1]), k))

    for k in range(len(feeds)):
        advance(k)
    while heap:
        end = heap[0][0]
        taken = []
        for k, (pair, many) in open_blocks.items():
            n = int(np.searchsorted(pair, end, side="right"))
            taken.append((pair[:n], many[:n]))
            open_blocks[k] = (pair[n:], many[n:])
        while heap and heap[0][0] == end:
            advance(heapq.heappop(heap)[1])
        pair = np.concatenate([t[0] for t in taken])
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        firsts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        yield pair[firsts], np.add.reduceat(np.concatenate([t[1] for t in taken])[order], firsts)


def with_best(stream: Iterator[tuple[np.ndarray, np.ndarray]], layout: Layout) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Adds whether a count is the largest of its B id, as soon as the stream has left that id."""
    pair, many = np.empty(0, np.uint64), np.empty(0, np.uint64)

    def judged(p: np.ndarray, m: np.ndarray):
        b = layout.b_of(p)
        firsts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        most = np.repeat(np.maximum.reduceat(m, firsts), np.diff(np.append(firsts, len(b))))
        return p, m, (m == most).astype(np.uint64)

    for p, m in stream:
        pair, many = np.concatenate([pair, p]), np.concatenate([many, m])
        done = int(np.searchsorted(layout.b_of(pair), layout.b_of(pair[-1:])[0]))
        if done:
            yield judged(pair[:done], many[:done])
            pair, many = pair[done:], many[done:]
    if len(pair):
        yield judged(pair, many)


def merged(runs: DataFrame, groups: int, layout_of) -> DataFrame:
    """``radix, grp, pairs``: the runs of every radix and group as one, with the best of each B id when there is one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, key, held = layout_of(), None, []

        def out() -> pa.RecordBatch:
            stream = merge(held)
            made = [pack(*columns) for columns in (with_best(stream, layout) if groups == 1 else stream)]
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([b"".join(made)], pa.binary())], ["radix", "grp", "pairs"])

        for batch in batches:
            for radix, grp, pairs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (radix, grp) and held:
                    yield out()
                    held = []
                key = (radix, grp)
                held.append(pairs)
        if held:
            yield out()

    dealt = runs.select("radix", F.pmod(F.xxhash64("run"), F.lit(groups)).alias("grp"), "pairs").repartition("radix", "grp")
    return map_partitions(dealt.sortWithinPartitions("radix", "grp"), run, "radix int, grp long, pairs binary")


def contributions(records: DataFrame, counts: DataFrame, groups: int, layout_of) -> DataFrame:
    """``run, gains``: per run and radix, the places of its documents with their sums of counts and their best links."""
    left = records.select("radix", F.pmod(F.xxhash64("run"), F.lit(groups)).alias("grp"), F.lit(1).alias("side"), "run", F.col("records").alias("blob"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    right = counts.select("radix", every.alias("grp"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("run"), F.col("pairs").alias("blob"))
    met = left.union(right).repartition("radix", "grp").sortWithinPartitions("radix", "grp", "side").select("run", "blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = layout_of()
        pair = count = best = np.empty(0, np.uint64)
        for batch in batches:
            runs, gains = [], []
            for at, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is None:
                    pair, count, best = unpack(blob, 3)
                    continue
                record, many = unpack(blob, 2)
                record = np.cumsum(record, dtype=np.uint64)
                place = np.searchsorted(pair, record >> np.uint64(layout.doc_bits))
                docs, which = np.unique(record & np.uint64((1 << layout.doc_bits) - 1), return_inverse=True)
                total, first = np.zeros(len(docs), np.uint64), np.zeros(len(docs), np.uint64)
                np.add.at(total, which, many * count[place])
                np.add.at(first, which, many * best[place])
                runs.append(at)
                gains.append(pack(docs, total, first))
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.int64()), pa.array(gains, pa.binary())], ["run", "gains"])

    return map_partitions(met, run, "run long, gains binary")


def gathered(documents: DataFrame, gains: DataFrame) -> DataFrame:
    """Every document with what its run's gains give it."""
    left = gains.select("run", F.lit(-1).alias("slot"), *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in DOC_COLUMNS.split(", ")], "gains")
    right = documents.withColumn("gains", F.lit(None).cast("binary"))
    met = left.unionByName(right).repartition("run").sortWithinPartitions("run", "slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros((2, 0), dtype=np.uint64)
        for batch in batches:
            runs, slots, blobs = batch.column("run").to_numpy(), batch.column("slot").to_numpy(), batch.column("gains")
            new = np.zeros((2, batch.num_rows), dtype=np.int64)
            edges = [0, *(np.flatnonzero(runs[1:] != runs[:-1]) + 1).tolist(), batch.num_rows]
            for s, e in zip(edges, edges[1:], strict=False):
                if s == e:
                    continue
                if runs[s] != now:
                    now, sums = runs[s], np.zeros((2, 0), dtype=np.uint64)
                first = s + int(np.searchsorted(slots[s:e], 0))
                for k in range(s, first):
                    docs, total, best = unpack(blobs[k].as_py(), 3)
                    if int(docs[-1]) >= sums.shape[1]:
                        sums = np.pad(sums, ((0, 0), (0, max(int(docs[-1]) + 1, 2 * sums.shape[1]) - sums.shape[1])))
                    sums[0, docs] += best
                    sums[1, docs] += total
                known = slots[first:e] < sums.shape[1]
                new[:, first:e][:, known] = sums[:, slots[first:e][known]]
            keep = pa.array(slots >= 0)
            columns = [batch.column(c.split()[0]) for c in DOC_COLUMNS.split(", ")]
            whole = pa.RecordBatch.from_arrays([*columns, *map(pa.array, new)], [*(c.split()[0] for c in DOC_COLUMNS.split(", ")), "n_best", "count_sum"])
            yield whole.filter(keep)

    return map_partitions(met, run, f"{DOC_COLUMNS}, n_best long, count_sum long")


def align(
    df: DataFrame, vocabulary: str, model: str, ranks: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row.

    A is a byte-level vocabulary over blank and text, B a piece model over the text, to which it adds the blank. Both
    tile the same bytes: groups end where a token of each does, a link is a pair of occurrences that share bytes, and
    a pair's count is the number of its links in all rows. ``n_best`` counts a row's links whose count is the largest
    of their B id (ties included), ``count_sum`` adds up the counts of its links.

    A null or empty text, or one that either tokenizer does not give back, has no tokens: zeros, and an empty
    ``groups_sha256``. Repeated rows count as often as they occur; a null id stays null; an empty table gives an
    empty one; other columns are not read. A task holds a run, or ``FAN`` blocks and the counts of a radix, of which
    there are at most as many as pairs of ids.
    """
    layout_of = functools.partial(layout, vocabulary, model)
    table = stored(spill(keyed(df, id_col, text_col), vocabulary, ranks, model), "spill")
    records = table.where(F.col("radix").isNotNull())
    runs = records.groupBy("radix").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    pairs, left = records.select("radix", "run", "pairs"), runs
    while True:
        groups = -(-left // FAN) or 1
        pairs = stored(merged(pairs, groups, layout_of), "pairs").withColumnRenamed("grp", "run")
        if groups == 1:
            break
        left = groups
    gains = contributions(records, pairs, -(-runs // FAN) or 1, layout_of)
    documents = table.where(F.col("radix").isNull()).select("run", "slot", *[c.split()[0] for c in DOC_COLUMNS.split(", ")])
    out = gathered(documents, gains)
    return out.select(id_back("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def layout(vocabulary: str, model: str) -> Layout:
    return Layout(len(a_bytes(vocabulary)), len(b_bytes(model)))
