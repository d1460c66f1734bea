"""SimHash near-dedup with anchor points of a covering code.

A fingerprint has bit b set when over half of the 64-bit hashes (XXH64, seed 42)
of the text's word shingles have it, repeats included.  Fingerprints at two or
fewer differing bits are linked; groups are the connected components.

Links are found by anchor points: the codewords of a covering code.  Every
fingerprint lies within the covering radius R of the anchor it decodes to, its
home; a fingerprint at distance d or less from it is within R + d of that anchor.
So fingerprints are sent to the homes of all words within distance d of them
(each is an anchor within R + d) and compared there with the fingerprints at
home.  A pair meets exactly once in either direction, so ``home < visitor`` finds
each link once and no link is missed.

The code is a direct sum of perfect codes, of which decoding is a table lookup:
two binary Golay codes (23 bits, radius 3) and, for more fingerprints, a Hamming
code (15 bits, radius 1); the remaining bits are not part of an anchor.  How many
parts are used changes the number of comparisons, never the links.

Only distinct fingerprints are compared: documents are first grouped by
fingerprint, so a group of thousands of copies is one row.  Components are found
by alternating large-star and small-star steps (Kiveris et al., 2014) on links
between distinct fingerprints.

Defined cases: a null or empty text, or one without words, has fingerprint zero,
linked like any other; a text of fewer words than a shingle is one shingle;
repeated rows fall into one component; rows with a null id get the component of
their fingerprint's other rows, or null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StructField, StructType

from . import kernel
from .shared import cut, discard, map_batches, release, stored, with_text_columns

SEED = 42
SHINGLE = 3
DISTANCE = 2
#: Fingerprints for each anchor beyond which the Hamming part is added.
CROWD = 8


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """A fingerprint (unsigned) for each text."""
    parts = [np.zeros(0, np.uint64)]
    digest = xxhash.xxh64_intdigest
    for _, _, words in kernel.word_slices(texts, lower=True, limit=kernel.SLICE_BYTES // 4):
        counts = words.counts()
        # the words with one space after each: a shingle is one stretch of these bytes
        size = words.ends - words.starts
        keep = np.zeros(len(words.data) + 1, bool)
        keep[:-1] = ~kernel._SPACE[words.data]
        place = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size + 1, out=place[1:])
        joined = np.full(int(place[-1]), 32, np.uint8)
        target = np.ones(int(place[-1]), bool)
        target[place[1:] - 1] = False
        joined[target] = words.data[keep[:-1]]
        text = joined.tobytes()
        n_shingles = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
        row = np.repeat(np.arange(words.rows), n_shingles)
        begin = words.word_off[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles))
        end = np.minimum(begin + shingle, words.word_off[row + 1])
        hashes = np.fromiter((digest(text[a:b], SEED) for a, b in zip(place[begin].tolist(), (place[end] - 1).tolist())), np.uint64, len(row))
        made = np.zeros(words.rows, np.uint64)
        some = np.flatnonzero(n_shingles)
        if len(some):
            bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.zeros((len(some), 64), np.int64)
            starts = (np.cumsum(n_shingles) - n_shingles)[some]
            for j, (a, n) in enumerate(zip(starts.tolist(), n_shingles[some].tolist())):
                ones[j] = bits[a : a + n].sum(axis=0, dtype=np.int32) if n < 64 else _column_sums(bits[a : a + n])
            over = 2 * ones > n_shingles[some][:, None]
            made[some] = np.packbits(over, axis=1, bitorder="little").view("<u8")[:, 0]
        parts.append(made)
    return np.concatenate(parts)


def _column_sums(bits: np.ndarray) -> np.ndarray:
    """Sums of 64 columns of 0 and 1; 255 rows at a time fit the bytes of a machine word."""
    n = len(bits) // 255 * 255
    packed = bits.view(np.uint64)  # 8 columns in each number
    total = np.zeros(64, np.int64)
    if n:
        blocks = packed[:n].reshape(-1, 255, 8).sum(axis=1, dtype=np.uint64)
        total += blocks.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return total + packed[n:].sum(axis=0, dtype=np.uint64).view(np.uint8).astype(np.int64)


# --- the covering code -------------------------------------------------------

_GOLAY = 0b101011100011  # generator polynomial of the binary Golay code of 23 bits


@cache
def _decoder(kind: str) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(bits, radius, error of each syndrome, syndrome of each bit) of a perfect code."""
    if kind == "golay":
        n, radius, checks = 23, 3, 11
        syndrome = []
        for b in range(n):
            word = 1 << b
            for top in range(n - 1, checks - 1, -1):
                if word >> top & 1:
                    word ^= _GOLAY << (top - checks)
            syndrome.append(word)
    else:
        n, radius, checks = 15, 1, 4
        syndrome = [b + 1 for b in range(n)]
    error = np.zeros(1 << checks, np.uint32)
    for weight in range(1, radius + 1):
        for bits in combinations(range(n), weight):
            s = e = 0
            for b in bits:
                s, e = s ^ syndrome[b], e | 1 << b
            error[s] = e
    return n, radius, error, np.array(syndrome, np.uint32)


@cache
def _syndromes(kind: str) -> np.ndarray:
    """Syndrome of every 12-bit piece at shift 0 and 12, so that two lookups give a word's."""
    n, _, _, syndrome = _decoder(kind)
    out = np.zeros((2, 4096), np.uint32)
    for half in range(2):
        for b in range(12):
            if half * 12 + b < n:
                out[half] ^= np.where(np.arange(4096) >> b & 1, syndrome[half * 12 + b], 0).astype(np.uint32)
    return out


def _decode(kind: str, word: np.ndarray) -> np.ndarray:
    table = _syndromes(kind)
    return word ^ _decoder(kind)[2][table[0][word & 4095] ^ table[1][word >> 12]]


@cache
def _flips(n: int, weight: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(n), weight)], np.uint32)


def parts_for(n_fingerprints: int) -> tuple[str, ...]:
    return ("golay", "golay") if n_fingerprints <= CROWD << 24 else ("golay", "golay", "hamming")


def _pieces(prints: np.ndarray, parts: tuple[str, ...]) -> Iterator[tuple[str, int, np.ndarray]]:
    shift = 0
    for kind in parts:
        n = _decoder(kind)[0]
        yield kind, shift, (prints >> np.uint64(shift)).astype(np.uint32) & np.uint32((1 << n) - 1)
        shift += n


def homes(prints: np.ndarray, parts: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(len(prints), np.uint64)
    for kind, shift, piece in _pieces(prints, parts):
        out |= _decode(kind, piece).astype(np.uint64) << np.uint64(shift)
    return out


def visits(prints: np.ndarray, parts: tuple[str, ...], distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """(number of fingerprint, anchor): the homes of all words within ``distance``, each once."""
    # for each part, anchors by the number of flips that first reach them
    reach = []
    for kind, shift, piece in _pieces(prints, parts):
        seen = _decode(kind, piece)[:, None]
        levels = [(np.arange(len(prints)), seen[:, 0])]
        for weight in range(1, distance + 1):
            near = np.sort(_decode(kind, (piece[:, None] ^ _flips(_decoder(kind)[0], weight)[None]).ravel()).reshape(len(prints), -1), axis=1)
            new = np.c_[np.ones(len(near), bool), near[:, 1:] != near[:, :-1]]
            for old in range(seen.shape[1]):
                new &= near != seen[:, old : old + 1]
            who, where = np.nonzero(new)
            levels.append((who, near[who, where]))
            seen = np.concatenate([seen, near], axis=1) if weight < distance else seen
        reach.append((shift, levels))
    # combine the parts while the flips add up to the distance at most
    states = {0: (np.arange(len(prints)), np.zeros(len(prints), np.uint64))}
    for shift, levels in reach:
        grown: dict[int, list] = {}
        for used, (who, anchor) in states.items():
            for weight, (owner, piece) in enumerate(levels):
                if used + weight > distance:
                    continue
                start = np.searchsorted(owner, who)
                count = np.searchsorted(owner, who, side="right") - start
                left = np.repeat(np.arange(len(who)), count)
                right = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                grown.setdefault(used + weight, []).append((who[left], anchor[left] | piece[right].astype(np.uint64) << np.uint64(shift)))
        states = {}
        for used, found in grown.items():
            who = np.concatenate([f[0] for f in found])
            order = np.argsort(who, kind="stable")
            states[used] = (who[order], np.concatenate([f[1] for f in found])[order])
    return np.concatenate([s[0] for s in states.values()]), np.concatenate([s[1] for s in states.values()])


# --- links and components ----------------------------------------------------


def near_pairs(prints: DataFrame, parts: tuple[str, ...], distance: int = DISTANCE) -> DataFrame:
    """u < v: the pairs of distinct fingerprints (column ``print``) at ``distance`` or less."""
    out = StructType([StructField("anchor", LongType()), StructField("print", LongType())])
    block = 256

    def at_home(batches):
        for batch in batches:
            p = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(homes(p, parts).view(np.int64)), batch.column(0)], names=out.fieldNames())

    def visiting(batches):
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for a in range(0, len(every), block):
                p = every[a : a + block]
                who, anchor = visits(p, parts, distance)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(p[who].view(np.int64))], names=out.fieldNames())

    home = prints.select("print").transform(map_batches, at_home, out).withColumnRenamed("print", "u")
    visitor = prints.select("print").transform(map_batches, visiting, out).withColumnRenamed("print", "v")
    near = (F.col("h.anchor") == F.col("w.anchor")) & (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)
    return home.alias("h").join(visitor.alias("w"), near).select("u", "v")


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for every node of ``links`` (u, v)."""
    links = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    size = _state(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = cut(small.where("u <> v").distinct())
        now = _state(links)
        if now == size:
            break
        size = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def fingerprinted(docs: DataFrame, keep: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with ``print``, the fingerprint as a long."""
    made = StructType([StructField("print", LongType())])
    return with_text_columns(docs, "text", made, lambda texts: [pa.array(fingerprints(texts, shingle).view(np.int64))], keep)


def groups(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, print, component_id (smallest doc_id of the group) for each row of ``docs``."""
    rows = cut(fingerprinted(docs, ["doc_id"], shingle))
    prints = cut(rows.groupBy("print").agg(F.min("doc_id").alias("doc_id")))
    links = near_pairs(prints, parts_for(prints.count()), distance)
    found = cut(components(links))
    release(docs.sparkSession)
    roots = prints.join(found.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    named = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = cut(roots.select("print", "root").join(named, "root").select("print", "component_id"))  # so that the join below can split a large group
    return rows.join(labels, "print").select("doc_id", "print", "component_id")


# --- texts of some similarity ------------------------------------------------

SIMILAR = 0.8
SIMILAR_SHINGLE = 5
#: Bands of least shingle hashes: texts of similarity s share none of them with a probability of (1 - s**DEEP)**BANDS.
BANDS, DEEP = 64, 5
#: Bands that are compared first; they join nearly all near copies, so that few of the other bands have anything to compare.
FIRST_BANDS = 8
MINIMA = 256
#: Agreement of sketches from which a pair is compared by its shingles; 6 standard errors below SIMILAR.
LOOSE = 0.65
#: Members of a group, and shingles of them, that one task compares; see _links for more.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 22
_ROWS = 512  # members that are compared with their smallest at a time


def shingle_hashes(words: kernel.Words, shingle: int = SIMILAR_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle, in order of rows; a text of fewer words is one shingle."""
    hashes, counts = words.hashes(), words.counts()
    first, h = words.windows(hashes, shingle)
    row = words.row_of_word()[first]
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    if len(short):
        whole = [int(kernel.window_hashes(hashes[words.word_off[i] : words.word_off[i + 1]], np.zeros(1, np.int64), int(counts[i]))[0]) for i in short]
        row, h = np.concatenate([row, short]), np.concatenate([h, np.array(whole, np.uint64)])
        order = np.argsort(row, kind="stable")
        row, h = row[order], h[order]
    return row, h


def band_keys(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """keys[row, band]: a hash of DEEP least hashes of the row's shingles."""
    out = np.zeros((rows, BANDS), np.uint64)
    begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
    if not len(begin):
        return out
    factors = kernel.mix(np.arange(1, BANDS * DEEP + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    for k in range(BANDS):
        key = np.full(len(begin), k + 1, np.uint64)
        for f in factors[k * DEEP : (k + 1) * DEEP]:
            key = kernel.mix(key * kernel._Q + np.minimum.reduceat(h * f, begin))
        out[row[begin], k] = key
    return out


def minima(words: kernel.Words, shingle: int = SIMILAR_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sketch[row, bin], number of different shingles of each row).

    A sketch has a byte of the least shingle hash of each of MINIMA bins, 0 for
    none (one-permutation hashing).
    """
    row, h = shingle_hashes(words, shingle)
    bins = row.astype(np.uint64) * np.uint64(MINIMA) + (h & np.uint64(MINIMA - 1))
    key = np.sort((bins << np.uint64(32)) | (h >> np.uint64(32)))  # rows of a slice are far fewer than 2**24
    bins = (key >> np.uint64(32)).astype(np.int64)
    least = np.r_[True, bins[1:] != bins[:-1]][: len(bins)]
    out = np.zeros(words.rows * MINIMA, np.uint8)
    out[bins[least]] = (key[least] & np.uint64(0xFFFFFFFF)) % np.uint64(255) + np.uint64(1)
    different = np.r_[True, key[1:] != key[:-1]][: len(key)]
    return out.reshape(-1, MINIMA), np.bincount(bins[different] // MINIMA, minlength=words.rows)


def _sketched(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), print (fingerprint), copy (digest of the words, A-Z lower-cased), n (different shingles), bands, sketch."""
    made = StructType([StructField("print", LongType()), StructField("copy", LongType()), StructField("n", LongType()), StructField("bands", ArrayType(LongType())), StructField("sketch", BinaryType())])

    def fn(texts: pa.Array) -> list[pa.Array]:
        copies, sizes, bands, sketches = [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], []
        for _, _, words in kernel.word_slices(texts, lower=True):
            bands.append(band_keys(*shingle_hashes(words), words.rows).ravel())
            sketch, n = minima(words)
            sketches += [x.tobytes() for x in sketch]
            sizes.append(n)
            copies += [xxhash.xxh64_intdigest(b" ".join(words.text(i).split()), SEED) for i in range(words.rows)]
        offsets = pa.array(np.arange(len(copies) + 1, dtype=np.int32) * BANDS)
        return [pa.array(fingerprints(texts).view(np.int64)), pa.array(np.array(copies, np.uint64).view(np.int64)), pa.array(np.concatenate(sizes)), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(bands).view(np.int64))), pa.array(sketches, pa.binary())]

    return with_text_columns(docs.select(*_row_key(docs), "text"), "text", made, fn, ["doc_id", "key"])


def _row_key(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("key")]


def _forest(members: int, near) -> tuple[list[int], list[int]]:
    """Links that connect what all pairs with ``near`` would: near(i, others) tells which of the others are linked to i."""
    u, v, left = [], [], np.arange(members)
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            found = left[hit].tolist()
            u += [i] * len(found)
            v += found
            queue += found
            left = left[~hit]
    return u, v


def _sketches_near(sketches: list[bytes]):
    every = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, MINIMA)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        x, out = every[i], []
        for a in range(0, len(others), BLOCK):
            y = every[others[a : a + BLOCK]]
            either = ((x != 0) | (y != 0)).sum(axis=1)
            out.append(((x == y) & (x != 0)).sum(axis=1) >= LOOSE * np.maximum(either, 1))
        return np.concatenate(out)

    return near


def _texts_near(texts: list[str], similar: float):
    """Exact Jaccard similarity of the sets of shingles (as 64-bit hashes)."""
    sets = []
    for _, _, words in kernel.word_slices(pa.array(texts, pa.string()), lower=True):
        row, h = shingle_hashes(words)
        at = np.searchsorted(row, np.arange(words.rows + 1))
        sets += [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:])]
    size = np.array([len(x) for x in sets])

    def near(i: int, others: np.ndarray) -> np.ndarray:
        out = np.zeros(len(others), bool)
        for k in np.flatnonzero((size[others] >= similar * size[i]) & (similar * size[others] <= size[i])):
            y = sets[others[k]]
            at = np.minimum(np.searchsorted(sets[i], y), size[i] - 1)
            both = int((sets[i][at] == y).sum())
            out[k] = both >= similar * (size[i] + len(y) - both) - 1e-9
        return out

    return near


def _links(grouped: DataFrame, payload: DataFrame, near_of) -> DataFrame:
    """u, v: forests of the groups ``anchor`` of ``grouped`` (anchor, copy, n); near_of makes ``near`` from the members' ``payload`` (copy, data).

    A group of up to BLOCK members (and BLOCK_SHINGLES) is compared in one task.
    Of a larger one every member is compared with the smallest; only members
    that this does not link (strays) are compared with all others, block by block,
    so a large group of near copies costs as many rows as it has members.
    """
    sized = grouped.groupBy("anchor").agg(F.count("*").alias("members"), F.sum("n").alias("total"), F.min("copy").alias("pivot")).where("members > 1")
    sized = cut(sized.withColumn("large", F.expr(f"members > {BLOCK} or total > {BLOCK_SHINGLES}")))
    found = _compared(grouped.join(sized.where("not large").select("anchor"), "anchor").select("anchor", F.lit(0).alias("i"), F.lit(0).alias("j"), "copy"), payload, near_of)
    if sized.where("large").isEmpty():
        return found
    data = payload.select(F.col("copy").alias("pivot"), F.col("data").alias("of_pivot"))
    members = grouped.join(sized.where("large").select("anchor", "pivot"), "anchor").join(payload, "copy").join(data, "pivot")
    out = StructType([StructField("anchor", LongType()), StructField("copy", LongType()), StructField("n", LongType()), StructField("pivot", LongType()), StructField("near", BooleanType())])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                b = batch.slice(a, _ROWS)
                pivots = b.column(5).dictionary_encode()  # a batch has few
                every = near_of(pivots.dictionary.to_pylist() + b.column(4).to_pylist())
                of, first = pivots.indices.to_numpy(), len(pivots.dictionary)
                near = np.zeros(b.num_rows, bool)
                for k in range(first):
                    own = np.flatnonzero(of == k)
                    near[own] = every(k, first + own)
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(near)], names=out.fieldNames())

    pivoted = stored(members.select("anchor", "copy", F.col("n").cast("long").alias("n"), "pivot", "data", "of_pivot").transform(map_batches, run, out))
    found = found.unionByName(pivoted.where("near and copy <> pivot").select(F.col("pivot").alias("u"), F.col("copy").alias("v")))
    blocks = lambda df, name: df.groupBy("anchor").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias(name))
    strays = pivoted.where("not near and copy <> pivot")
    if strays.isEmpty():
        return found
    place = lambda name: F.pmod(F.xxhash64("copy"), F.col(name)).cast("int")
    meeting = blocks(strays, "of_strays").join(blocks(pivoted, "of_all"), "anchor")
    every = pivoted.join(meeting, "anchor").select("anchor", F.explode(F.expr("sequence(0, of_strays - 1)")).alias("i"), place("of_all").alias("j"), "copy")
    stray = strays.join(meeting, "anchor").select("anchor", place("of_strays").alias("i"), F.explode(F.expr("sequence(0, of_all - 1)")).alias("j"), "copy")
    return found.unionByName(_compared(every.unionByName(stray).distinct(), payload, near_of))


def _compared(placed: DataFrame, payload: DataFrame, near_of) -> DataFrame:
    """u, v: a forest for each (anchor, i, j) of ``placed`` (anchor, i, j, copy), made in one task."""
    placed = placed.join(payload, "copy").repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", "copy")
    out = StructType([StructField("u", LongType()), StructField("v", LongType())])

    def run(batches):
        key, copies, data = None, [], []

        def done():
            u, v = _forest(len(copies), near_of(data))
            return pa.RecordBatch.from_arrays([pa.array([copies[i] for i in x], pa.int64()) for x in (u, v)], names=out.fieldNames())

        for b in batches:
            for a in range(0, b.num_rows, BLOCK):
                part = b.slice(a, BLOCK)
                for *now, copy, x in zip(*(part.column(i).to_pylist() for i in range(5))):
                    if now != key:
                        if len(copies) > 1:
                            yield done()
                        key, copies, data = now, [], []
                    copies.append(copy)
                    data.append(x)
        if len(copies) > 1:
            yield done()

    return placed.select("anchor", "i", "j", "copy", "data").transform(map_batches, run, out)


def print_links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """u, v: links that connect copies as their fingerprints do; prints (copy, print) has each copy once."""
    named = cut(prints.groupBy("print").agg(F.min("copy").alias("first")))  # one copy stands for all of its fingerprint
    alike = prints.join(named, "print").where("copy <> first").select(F.col("first").alias("u"), F.col("copy").alias("v"))
    near = near_pairs(named, parts_for(named.count()), distance)
    of = lambda name: named.select(F.col("print").alias(name), F.col("first").alias(f"{name}_first"))
    return alike.unionByName(near.join(of("u"), "u").join(of("v"), "v").select(F.col("u_first").alias("u"), F.col("v_first").alias("v")))


def _grouped(docs: DataFrame, similar: float, by_prints: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key and copy of each row; copy and group of each different text); see ``similar_groups`` and ``keep_one``."""
    each = stored(_sketched(docs))
    rows = cut(each.select("doc_id", "key", "copy"))
    printed = cut(print_links(each.select("copy", "print").dropDuplicates(["copy"]))) if by_prints else None
    release(docs.sparkSession)
    texts = stored(each.where("n > 0").select("copy", "n", "bands", "sketch").dropDuplicates(["copy"]))
    discard(each)
    sketches = texts.select("copy", F.col("sketch").alias("data"))
    banded = lambda first, size: texts.select(F.explode(F.slice("bands", first, size)).alias("anchor"), "copy", F.lit(0).alias("n"))
    links = cut(_links(banded(1, FIRST_BANDS), sketches, _sketches_near))
    # a band whose texts are one component already has nothing to add
    joined = cut(components(links)).select(F.col("node").alias("copy"), "root")
    release(docs.sparkSession)
    others = banded(FIRST_BANDS + 1, BANDS - FIRST_BANDS)
    named = others.join(joined, "copy", "left").withColumn("root", F.coalesce("root", "copy"))
    mixed = named.groupBy("anchor").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("anchor")
    more = cut(_links(others.join(mixed, "anchor", "left_semi"), sketches, _sketches_near))
    loose = cut(components(links.unionByName(more)))
    release(docs.sparkSession)
    clusters = loose.select(F.col("root").alias("anchor"), F.col("node").alias("copy")).unionByName(loose.select(F.col("root").alias("anchor"), F.col("root").alias("copy"))).distinct()
    clusters = cut(clusters.join(texts.select("copy", "n"), "copy").select("anchor", "copy", "n"))
    discard(texts)
    # copies are counted before any join, so that a large group of them is one row for each task
    shown = cut(rows.groupBy("copy").agg(F.min(F.struct("key", "doc_id")).alias("at"))).join(clusters.select("copy"), "copy", "left_semi").select("copy", F.col("at.key").alias("__key"), F.col("at.doc_id").alias("__id"))
    read = docs.select(*_row_key(docs), F.col("text").cast("string").alias("data"))
    read = read.join(shown, (F.col("key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id"))).select("copy", "data").dropDuplicates(["copy"])
    read = stored(read)
    near = _links(clusters, read, lambda data: _texts_near(data, similar))
    found = cut(components(cut(near if printed is None else near.unionByName(printed))))
    discard(read)
    release(docs.sparkSession)
    roots = found.select(F.col("node").alias("copy"), "root")
    return rows, cut(rows.select("copy").distinct().join(roots, "copy", "left").select("copy", F.coalesce("root", "copy").alias("group")))


def similar_groups(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, component_id (smallest doc_id of the group) for each id of ``docs`` (doc_id, text).

    Groups are connected by texts with the same words (A-Z lower-cased) and by
    texts whose five-word shingles have a Jaccard similarity of ``similar`` or
    more.  Texts that share a band of least hashes (by the formula at BANDS, a
    pair of 0.8 shares none about once in 10**11) and whose sketches agree in
    LOOSE or more form clusters; within a cluster the sets of shingles themselves
    are compared, and only those links make groups.  A cluster emits a forest,
    never all its pairs.
    """
    rows, found = _grouped(docs, similar)
    rows = rows.where("doc_id is not null").select("doc_id", "copy").join(found, "copy")
    named = rows.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return rows.join(named, "group").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``docs`` with one row for each group of similar texts: that of the smallest id, rows without an id last.

    Groups are connected by fingerprints at DISTANCE or less, found by anchor
    points as in ``groups``, and by the links of ``similar_groups``, since near copies
    of SIMILAR often have fingerprints that lie further apart.  Of rows that have both the id and the text of the kept one, any one stays.
    """
    rows, found = _grouped(docs, similar, by_prints=True)
    each = rows.groupBy("doc_id", "key", "copy").agg(F.count("*").alias("rows"))
    first = cut(each.groupBy("copy").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "rows")).alias("at")))
    kept = first.join(found, "copy").groupBy("group").agg(F.min("at").alias("at"))
    kept = cut(kept.select(F.col("at.doc_id").alias("__id"), F.col("at.key").alias("__key"), F.col("at.rows").alias("__rows")))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__key"))
    out = docs.join(kept.where("__rows = 1"), same, "left_semi")
    several = kept.where("__rows > 1")
    if several.isEmpty():
        return out
    again = docs.withColumn("__of", F.xxhash64(F.col("text").cast("string"))).join(several, same, "left_semi").dropDuplicates(["doc_id", "__of"])
    return out.unionByName(again.select(*[F.col(f"`{c}`") for c in docs.columns]))
