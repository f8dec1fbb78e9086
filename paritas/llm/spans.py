"""Long exact spans shared between documents.

A span of at least W characters stands in two texts when a window of W characters does. Consecutive windows that share
their minimiser (the least hash of the M-character strings within a window) travel together as one packed string, a
super-k-mer, to the bucket of that minimiser, which is the same for equal windows wherever they stand; in the bucket,
sorting brings equal windows together. A minimiser that occurs in one document only can't be that of a shared window,
so super-k-mers are sent only for minimisers of several documents; a bitmap sized by their number tells them, and what it
lets through wrongly changes nothing but the volume. Equal strings of one portion of documents travel once.

A minimiser whose strings have more than HOT windows in all (a passage that a third of all documents may contain) is no
single bucket: its windows are told apart by their least hashes under further functions too, as many as halve the bucket
often enough, and consecutive windows that share all of these travel together, again as one packed string. Of such
strings the equal ones are first combined to one with its least and greatest document, so that a string of very many
documents is one row of its bucket; what is found there is joined back to where the string stands. Equality is that of the
characters everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paritas.session import written

W, M = 240, 32

#: Characters handled at a time when minimisers are sought, and when windows are sorted.
BLOCK, SORTED = 262_144, 1_500_000

#: Bits of the bitmap for each shared minimiser, and the least and most bits it has.
SPARSE, LEAST_BITS, MOST_BITS = 128, 1 << 23, 1 << 30

#: Windows of one minimiser beyond which it is told apart further, and the most further hashes.
HOT, LEVELS = 2_000_000, 16

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def rolling_hash(codes: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each run of `length` characters, by doubling: of 2k characters from two of k."""
    with np.errstate(over="ignore"):
        h = (codes.astype(np.uint64) + np.uint64(1)) * _MIX
        h ^= h >> np.uint64(29)
        h *= _BASE
        out, taken, width, power = None, 0, 1, _BASE
        while True:
            if length & width:
                if out is None:
                    out = h
                else:  # what is taken stands before the next part
                    n = len(codes) - taken - width + 1
                    out = out[:n] * power + h[taken : taken + n]
                taken += width
            if taken == length:
                return out
            h = h[:-width] * power + h[width:]
            width, power = width * 2, power * power


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours, by doubling."""
    width = 1
    while width * 2 <= n:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (n - width)], h[n - width :]) if n > width else h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    with np.errstate(over="ignore"):
        h *= _MIX
    return h ^ (h >> np.uint64(32))


def super_kmers(codes: np.ndarray, bounds: np.ndarray, window: int = W, m: int = M) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts one after another (bounds: where each begins, and the end): the minimiser, first character and end of
    each run of windows of one text that share their minimiser."""
    none = np.zeros(0, np.int64)
    if len(codes) < window:
        return none.astype(np.uint64), none, none
    least = _least(_mixed(rolling_hash(codes, m)), window - m + 1)
    valid = np.zeros(len(least), bool)
    first = np.zeros(len(least) + 1, bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= window:
            valid[a : b - window + 1] = first[a] = True
    first[1:-1] |= least[1:] != least[:-1]
    starts = np.flatnonzero(first[:-1] & valid)
    # A run ends before the next start or where its text has no further window.
    after = np.flatnonzero((first[1:] | ~np.append(valid[1:], False)) & valid)
    return least[starts], starts, after + window


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of a batch (doc_id, text) in blocks: codes, bounds, and each piece's doc_id and place in its text. A text
    longer than a block is cut into pieces that overlap by a window less one character, so no window is lost."""
    codes: list[np.ndarray] = []
    docs: list[int] = []
    places: list[int] = []
    size = 0

    def block():
        bounds = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int64)
        return np.concatenate(codes), bounds, np.array(docs, np.int64), np.array(places, np.int64)

    for i in range(batch.num_rows):
        text = batch.column(1)[i].as_py()
        if len(text) < W:
            continue
        doc, all_codes = batch.column(0)[i].as_py(), np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        for at in range(0, len(all_codes) - W + 1, BLOCK):
            piece = all_codes[at : at + BLOCK + W - 1]
            codes.append(piece)
            docs.append(doc)
            places.append(at)
            size += len(piece)
            if size >= BLOCK:
                yield block()
                codes, docs, places, size = [], [], [], 0
    if codes:
        yield block()


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Minimisers with the least and greatest doc_id of a block, and how many windows their different strings have."""
    for batch in batches:
        for codes, bounds, docs, _ in _blocks(batch):
            least, starts, ends = super_kmers(codes, bounds)
            if not len(least):
                continue
            doc = docs[np.searchsorted(bounds, starts, "right") - 1]
            # Strings are told apart by length and both ends, which is enough to estimate a bucket.
            h = rolling_hash(codes, M)
            likely = np.stack([least, h[starts] ^ (h[ends - M] >> np.uint64(1)), (ends - starts).astype(np.uint64)], 1)
            order = np.lexsort(likely.T[::-1])
            likely, doc = likely[order], doc[order]
            heads = np.flatnonzero(np.append(True, likely[1:, 0] != likely[:-1, 0]))
            fresh = np.append(True, (likely[1:] != likely[:-1]).any(1))
            windows = np.add.reduceat(fresh * (likely[:, 2].astype(np.int64) - W + 1), heads)
            columns = likely[heads, 0].view(np.int64), np.minimum.reduceat(doc, heads), np.maximum.reduceat(doc, heads), windows
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor", "low", "high", "windows"])


def _read_bitmap(path: str, bits: int, hot: bool) -> np.ndarray:
    """The bits of hot minimisers, or of those shared ones that share no bit with a hot one."""
    import pyarrow.dataset as ds

    place = urlparse(path)
    rows = ds.dataset(place.path if place.scheme in ("", "file") else path, format="parquet").to_table().to_pylist()
    out = np.zeros(bits // 8, np.uint8)
    for row in sorted(rows, key=lambda r: r["hot"]):
        part, at = np.frombuffer(row["bitmap"], np.uint8), slice((row["part"] - 1) * 4096, row["part"] * 4096)
        if hot and row["hot"]:
            out[at] = part
        elif not hot:
            out[at] = out[at] & ~part if row["hot"] else part
    return out


def _has_bit(bitmap: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    at = (anchors & np.uint64(len(bitmap) * 8 - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _split_runs(codes: np.ndarray, least: np.ndarray, starts: np.ndarray, ends: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows cut where one of `levels` further minimisers changes: the key of them all, first character and end."""
    many = ends - starts - W + 1
    at = np.repeat(starts - np.cumsum(many) + many, many) + np.arange(many.sum())
    key, h = np.repeat(least, many), rolling_hash(codes, M)
    for level in range(levels):
        with np.errstate(over="ignore"):
            h = _mixed(h + _MIX * np.uint64(2 * level + 3))
            key = _mixed(key * _BASE + _least(h, W - M + 1)[at])
    first = np.append(True, (at[1:] - at[:-1] != 1) | (key[1:] != key[:-1]))
    heads = np.flatnonzero(first)
    return key[heads], at[heads], at[np.append(heads[1:], len(at)) - 1] + W


PACKED = "anchor long, packed binary, docs array<long>, places array<long>"


def _packer(path: str, bits: int, levels: int = 0):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Super-k-mers of shared anchors: anchor, the packed string, and where it stands (docs, places). levels: those of
        hot anchors, told apart by so many further minimisers; 0: those of all others."""
        wanted = _read_bitmap(path, bits, levels > 0)
        for batch in batches:
            for codes, bounds, docs, places in _blocks(batch):
                least, starts, ends = super_kmers(codes, bounds)
                hit = _has_bit(wanted, least)
                least, starts, ends = least[hit], starts[hit], ends[hit]
                if not len(least):
                    continue
                if levels:
                    least, starts, ends = _split_runs(codes, least, starts, ends, levels)
                piece = np.searchsorted(bounds, starts, "right") - 1
                doc, place = docs[piece], places[piece] + starts - bounds[piece]
                # Byte offsets of the characters give each packed string as a slice.
                raw = codes.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
                leads = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))
                strings = [raw[a:b] for a, b in zip(leads[starts].tolist(), leads[ends].tolist(), strict=True)]
                number: dict[bytes, int] = {}
                which = np.fromiter((number.setdefault(s, len(number)) for s in strings), np.int64, len(strings))
                order = np.argsort(which, kind="stable")
                sizes = np.bincount(which)
                firsts = order[np.cumsum(sizes) - sizes]
                offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(least[firsts].view(np.int64)),
                        pa.array(list(number), pa.binary()),
                        pa.ListArray.from_arrays(offsets, pa.array(doc[order])),
                        pa.ListArray.from_arrays(offsets, pa.array(place[order])),
                    ],
                    ["anchor", "packed", "docs", "places"],
                )

    return pack


def _same_windows(codes: np.ndarray, at: np.ndarray, window: int = W) -> np.ndarray:
    """A number for each window (at: where it starts, ascending), the same for equal windows and only for those."""
    h = rolling_hash(codes, window)[at]
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    head = np.append(True, sorted_h[1:] != sorted_h[:-1])
    group = np.empty(len(at), np.int64)
    group[order] = np.cumsum(head) - 1
    model = at[order[np.flatnonzero(head)]][group]  # the first window of the group
    # Equal hashes are held against the characters: one by one along runs, all of them where a run begins.
    runs_on = np.zeros(len(at), bool)
    runs_on[1:] = (np.diff(at) == 1) & (np.diff(model) == 1)
    bad = np.zeros(len(at), bool)
    along = np.flatnonzero(runs_on)
    bad[along] = codes[at[along] + window - 1] != codes[model[along] + window - 1]
    begin = np.flatnonzero(~runs_on & (at != model))
    span = np.arange(window)
    for i in range(0, len(begin), 4096):
        b = begin[i : i + 4096]
        bad[b] = (codes[at[b][:, None] + span] != codes[model[b][:, None] + span]).any(1)
    if bad.any():  # windows that differ under one hash: told apart by their characters
        clash = np.flatnonzero(np.isin(group, group[bad]))
        names: dict[bytes, int] = {}
        fresh = group.max() + 1
        for i in clash.tolist():
            group[i] = fresh + names.setdefault(codes[at[i] : at[i] + window].tobytes(), len(names))
        group = np.unique(group, return_inverse=True)[1]
    return group


def _shared_runs(packed: list[bytes], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of strings with the least and greatest document of each: string number, begin and end of each stretch whose windows
    stand in several documents."""
    text = b"".join(packed).decode("utf-8", "surrogatepass")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(p) if p.isascii() else len(p.decode("utf-8", "surrogatepass")) for p in packed), np.int64, len(packed))
    begins = np.cumsum(sizes) - sizes
    windows = sizes - W + 1
    piece = np.repeat(np.arange(len(packed)), windows)
    at = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(begins, windows)
    group = _same_windows(codes, at)
    groups = int(group.max()) + 1
    order = np.argsort(group, kind="stable")
    heads = np.searchsorted(group[order], np.arange(groups))
    shared = (np.minimum.reduceat(low[piece][order], heads) != np.maximum.reduceat(high[piece][order], heads))[group]
    # Runs of shared windows within a piece.
    before = np.append(False, shared[:-1] & (piece[1:] == piece[:-1]))
    after = np.append(shared[1:] & (piece[1:] == piece[:-1]), False)
    a, b = np.flatnonzero(shared & ~before), np.flatnonzero(shared & ~after)
    return piece[a], at[a] - begins[piece[a]], at[b] - begins[piece[b]] + W


def _covered(t: pa.Table) -> pa.RecordBatch:
    """doc_id, a, b: stretches of the texts whose windows stand in another document too, from whole buckets of PACKED."""
    docs, places = (t[c].combine_chunks() for c in ("docs", "places"))
    ends = np.asarray(docs.offsets)
    ends = ends - ends[0]
    of, place = docs.flatten().to_numpy(), places.flatten().to_numpy()
    run, a, b = _shared_runs(t["packed"].to_pylist(), np.minimum.reduceat(of, ends[:-1]), np.maximum.reduceat(of, ends[:-1]))
    many = np.diff(ends)[run]
    total = np.cumsum(many)
    occurrence = np.repeat(ends[:-1][run] - (total - many), many) + np.arange(total[-1] if len(total) else 0)
    columns = of[occurrence], place[occurrence] + np.repeat(a, many), place[occurrence] + np.repeat(b, many)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["doc_id", "a", "b"])


STRETCHES = "anchor long, packed binary, a long, b long"


def _within(t: pa.Table) -> pa.RecordBatch:
    """STRETCHES of each string that stand in several documents, from whole buckets of anchor, packed, low, high."""
    run, a, b = _shared_runs(t["packed"].to_pylist(), t["low"].to_numpy(), t["high"].to_numpy())
    at = pa.array(run)
    columns = [t[c].combine_chunks().take(at) for c in ("anchor", "packed")]
    return pa.RecordBatch.from_arrays([*columns, pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["anchor", "packed", "a", "b"])


def _whole_buckets(count):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets come sorted by anchor; whole anchors are handled at a time, about SORTED characters of them."""
        held: list[pa.RecordBatch] = []
        size = 0

        for batch in batches:
            anchors = batch.column(0).to_numpy()
            bytes_to = np.cumsum(pc.binary_length(batch.column(1)).to_numpy())
            cuts = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
            if held and len(anchors) and held[-1].column(0)[-1].as_py() != anchors[0]:
                cuts = np.append(0, cuts)
            at = 0
            for cut in cuts.tolist():
                here = int(bytes_to[cut - 1]) if cut else 0
                done = int(bytes_to[at - 1]) if at else 0
                if size + here - done >= SORTED:
                    held.append(batch.slice(at, cut - at))
                    yield count(pa.Table.from_batches(held).combine_chunks())
                    held, size, at = [], 0, cut
            if at < batch.num_rows:
                held.append(batch.slice(at))
                size += int(bytes_to[-1]) - (int(bytes_to[at - 1]) if at else 0)
        if held:
            yield count(pa.Table.from_batches(held).combine_chunks())

    return counted


def _levels(windows: int, hot: int) -> int:
    """How many further minimisers a bucket of so many windows needs when each halves it."""
    return min(LEVELS, max(1, (windows // max(hot, 1)).bit_length()))


def shared_spans(documents: DataFrame, bits: int | None = None, hot: int = HOT) -> DataFrame:
    """documents (doc_id, text) -> doc_id, span_start, span_end: each maximal run of characters of a text of which every
    one lies in some stretch of at least W characters that stands verbatim in the text of another doc_id.

    Positions are code points from 0, the end exclusive. Null, empty and short texts have no spans; rows with a null
    doc_id count for nothing. Rows of one doc_id are one document: repeats within it don't count. Touching runs are one.
    Texts are searched whole, whatever their length. Other columns play no part. bits (of the bitmap) and hot make no
    difference to the result.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long"), "text").where(
        F.col("doc_id").isNotNull() & (F.length("text") >= W)
    )
    anchors = (
        texts.mapInArrow(_anchors, "anchor long, low long, high long, windows long")
        .groupBy("anchor")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("windows").alias("windows"))
        .where("low <> high")
    )
    # Written, so that the bitmap can be sized by their number; two numbers for each.
    anchors = written(anchors.select("anchor", "windows"), "anchors")
    n, most = anchors.agg(F.count(F.lit(1)), F.max("windows")).collect()[0]
    if not n:
        return spark.createDataFrame([], "doc_id long, span_start long, span_end long")
    bits = bits or min(MOST_BITS, max(LEAST_BITS, 1 << (n * SPARSE - 1).bit_length()))
    bit = F.pmod("anchor", F.lit(bits)) + 1
    bitmaps = anchors.groupBy((F.col("windows") > hot).alias("hot"), F.bitmap_bucket_number(bit).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bitmap")
    )
    # At most twice MOST_BITS / 8 bytes; the workers read one of them from the shared folder.
    folder = written(bitmaps, "bitmaps").inputFiles()[0].rsplit("/", 1)[0]
    stretches = (
        texts.mapInArrow(_packer(folder, bits), PACKED)
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_whole_buckets(_covered), "doc_id long, a long, b long")
    )
    if most > hot:
        # Written once: strings go to their buckets without their places, and what is found there comes back to these.
        packed = written(texts.mapInArrow(_packer(folder, bits, _levels(most, hot)), PACKED), "hot-strings")
        within = (
            packed.groupBy("anchor", "packed")
            .agg(F.min(F.array_min("docs")).alias("low"), F.max(F.array_max("docs")).alias("high"))
            .repartition("anchor")
            .sortWithinPartitions("anchor")
            .mapInArrow(_whole_buckets(_within), STRETCHES)
        )
        # A string of very many documents has a row for each portion of them; adaptive execution splits such a partition.
        found = packed.join(within, ["anchor", "packed"]).select("a", "b", F.inline(F.arrays_zip("docs", "places")))
        stretches = stretches.unionByName(found.select(F.col("docs").alias("doc_id"), (F.col("places") + F.col("a")).alias("a"), (F.col("places") + F.col("b")).alias("b")))
    # Stretches of one document are at most its super-k-mers; overlapping and touching ones are merged.
    order = Window.partitionBy("doc_id").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        stretches.withColumn("opens", F.coalesce((F.col("a") > reach).cast("int"), F.lit(1)))
        .withColumn("run", F.sum("opens").over(order))
        .groupBy("doc_id", "run")
        .agg(F.min("a").alias("span_start"), F.max("b").alias("span_end"))
        .drop("run")
    )
