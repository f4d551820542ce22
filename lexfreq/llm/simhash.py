"""Operator 3, near-duplicates by SimHash and meet-in-the-middle ball hashing.

Fingerprint: texts are lower-cased in A-Z, cut at ASCII white space into words and these into
three-word shingles, repeats included; a text of fewer words is one shingle, one without words has
fingerprint zero. A bit is set if it is set in over half of the shingles' XXH64 hashes (seed 42).

Links: fingerprints that differ in 3 bits or fewer. Every distinct fingerprint emits the variants
within half the radius, that is with 0, 1 or 2 bits flipped; pairs at distance 3 meet where one
side has flipped one bit and the other two. Variants are shuffled, and fingerprints that emitted the
same variant are linked. Not all variants are needed for every pair to meet at least once:
* An odd distance has one fingerprint with an even and one with an odd number of bits. It is
  enough that the even one flips two bits and the odd one flips one.
* Of any three positions two lie in the same half of the 64, so flipping two bits of the same half
  is enough.
That leaves 1 + 64 + 992 variants of an even fingerprint and 64 of an odd one, 561 on average
instead of 2,081, and no pair is lost.

A group of fingerprints at a variant is linked as a star around one member that flipped at most
one bit: by the triangle inequality every other member is within 3 of it, and pairs that both flipped two
bits and are that close meet elsewhere too. So links grow with the members of a group and not with its
pairs, and a group holds at most the 2,081 fingerprints of a ball. Copies share a fingerprint and
count once. Links are deduplicated and their distances verified.

Similar texts: `similar_documents` takes the components of fingerprints and checks their members exactly, by shingle sets. But three of 64 bits are
soon exceeded (texts with 0.8 of their five-word shingles in common differ in about ten), and short fingerprints within two bits lose every seventh
lone pair at 0.8, so texts farther apart are found by minima of hashes besides: two sets have the same minimum with a probability of their Jaccard similarity, whatever their sizes. Texts with five equal minima in one of 32 bands are a group, in which a pair
at 0.8 meets but for 3 in a million, at 0.85 but for 2 in a hundred million. Similarity is not transitive, so a star around one member would lose
pairs of others; members are compared by their shingle sets, all candidates exactly, in rounds, until any two of a group are in one component
or have been compared (see `_joined`). A pair whose sizes, or the parities of the numbers of their shingles in 512 classes, show that it is below
0.8 counts as compared.

Defined cases: null and empty texts have fingerprint zero and are linked like any other. Rows with
the same or a null doc_id each give a row; the component is the smallest doc_id that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexfreq.llm.components import components
from lexfreq.llm.scratch import arrow_map, bucketed, written
from lexfreq.llm.words import BASES, SPACED, find_words, grams, mix, slices

SHINGLE = 3
RADIUS = 3
SEED = 42
VARIANTS_PER_TASK = 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as an unsigned 64-bit number."""
    # Lower-casing and cutting bytes touches ASCII only, as wanted.
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    begins = (ends - lengths + 1)[:n].tolist()
    ends = ends[len(words) - n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[b:e], SEED) for b, e in zip(begins, ends)), np.uint64, n)
    ones = _bit_counts(hashes)
    return int(np.packbits(ones * 2 > n).view(">u8")[0])


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set, the highest bit first."""
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    if len(hashes) < 512:
        return np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (signed 64-bit) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch["text"]), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, fp bigint")


def _masks() -> tuple[np.ndarray, np.ndarray]:
    """What to flip, none first, then one bit, then two bits of a half; and how many bits that is."""
    single = [1 << i for i in range(64)]
    double = [single[i] | single[j] for half in (0, 32) for i in range(half, half + 32) for j in range(i + 1, half + 32)]
    masks = np.array([0, *single, *double], np.uint64)
    return masks, np.bitwise_count(masks).astype(np.int8)


def _blocks(target: np.ndarray, targets: int, *columns: np.ndarray) -> pa.RecordBatch:
    """Rows as blocks of bytes, one for each target that gets any."""
    order = np.argsort(target, kind="stable")
    cuts = np.searchsorted(target[order], np.arange(targets + 1))
    full = [t for t in range(targets) if cuts[t] < cuts[t + 1]]
    sorted_ = [c[order] for c in columns]
    return pa.RecordBatch.from_arrays(
        [pa.array(full, pa.int32()), *(pa.array([c[cuts[t]:cuts[t + 1]].tobytes() for t in full], pa.binary()) for c in sorted_)],
        ["target", "variants", "numbers"])


def _gathered(batches: Iterator[pa.RecordBatch], *kinds: type) -> Iterator[tuple]:
    """Each target of a task with all its rows."""
    parts: dict[int, list[tuple]] = {}
    for batch in batches:
        for target, *blocks in zip(batch["target"], batch["variants"], batch["numbers"]):
            parts.setdefault(target.as_py(), []).append(tuple(np.frombuffer(x.as_buffer(), k) for x, k in zip(blocks, kinds)))
    for target in list(parts):
        own = parts.pop(target)
        yield target, *(np.concatenate([x[i] for x in own]) for i in range(len(kinds)))


_BLOCKS = "target int, variants binary, numbers binary"


def _opens(groups: np.ndarray) -> np.ndarray:
    """Where a new group begins in sorted groups."""
    first = np.ones(len(groups), bool)
    first[1:] = groups[1:] != groups[:-1]
    return first


def _first_of_group(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    return values[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(values) else values


def links(distinct: DataFrame, count: int) -> DataFrame:
    """Pairs u, v of fingerprints at most 3 bits apart that join all such pairs into components.

    Variants travel as blocks of bytes, one per task and target: the variant and the number of the mask,
    from which the fingerprint follows. `count`, the number of fingerprints, sets the number of targets.
    """
    masks, flips = _masks()
    targets = max(1, -(-count * 561 // VARIANTS_PER_TASK))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps = batch["fp"].to_numpy().view(np.uint64)
            for at in range(0, len(all_fps), 1024):
                fps = all_fps[at:at + 1024]
                even = np.bitwise_count(fps) % 2 == 0
                for own, chosen in ((fps[even], np.arange(len(masks))), (fps[~even], np.arange(1, 65))):
                    if len(own):
                        variants = (own[:, None] ^ masks[chosen]).ravel()
                        target = (mix(variants) % np.uint64(targets)).astype(np.int64)
                        yield _blocks(target, targets, variants, np.tile(chosen.astype(np.uint16), len(own)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, z, number in _gathered(batches, np.uint64, np.uint16):
            order = np.argsort(z)
            z = z[order]
            same = np.zeros(len(z) + 1, bool)
            same[1:-1] = z[1:] == z[:-1]
            crowded = np.flatnonzero(same[:-1] | same[1:])
            z, number = z[crowded], number[order[crowded]]
            fp = z ^ masks[number]
            # Members with fewest flips come first in their group, then the smallest fingerprint.
            order = np.lexsort((fp, flips[number], z))
            z, u, flip = z[order], fp[order], flips[number][order]
            first = _opens(z)
            v = _first_of_group(first, u)
            near = (_first_of_group(first, flip) <= 1) & (u != v) & (np.bitwise_count(u ^ v) <= RADIUS)
            pairs = np.unique(np.stack([np.maximum(u, v)[near], np.minimum(u, v)[near]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0].view(np.int64)), pa.array(pairs[:, 1].view(np.int64))], ["u", "v"])

    emitted = arrow_map(distinct.select("fp"), emit, _BLOCKS).repartitionById(targets, "target")
    return arrow_map(emitted, meet, "u bigint, v bigint").distinct()


def linked(distinct: DataFrame) -> DataFrame:
    """Distinct fingerprints, with whatever stands beside them, and the root of their component."""
    members = components(links(distinct, distinct.count()))
    return distinct.join(members, distinct["fp"] == members["node"], "left").select(*distinct.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint as 16 lower-case hex digits, and component_id of every document."""
    own = written(fingerprints(docs, shingle), "fingerprints")
    joined = linked(written(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct_fingerprints"))
    smallest = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = joined.join(smallest, "root").select("fp", "component_id")
    return own.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SIMILARITY = 0.8
# Two texts at similarity j have the same minima in a band with probability j^ROWS, so at 0.8 they meet in some band but for 3 in a million.
BANDS = 32
ROWS = 5
# A band that this share of all texts has, or twice that, is frequent; texts are counted in chunks.
FREQUENT = 2.0**-13
CHUNK = 1 << 16
# Bits of the map of texts that share a band (8 MB), and shingles in a bucket of their sets (32 MB).
PLACES = 1 << 26
# Bits of the parities of a set, in words of 64.
PARITY_WORDS = 8
SHINGLES_PER_BUCKET = 1 << 22
# A bucket is finished in a round if this many times the round's centres, or fewer, are outside its largest component.
LAST = 64
_LOTS = np.random.default_rng(SEED).integers(0, 1 << 32, (2, BANDS * ROWS), np.uint32) | np.array([[0], [1]], np.uint32)


def _bands(shingles: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A number for each band of each set; the sets stand one after the other and none is empty."""
    spread = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(begins), BANDS), np.uint64)
    for i in range(BANDS * ROWS):
        own = (spread ^ _LOTS[0, i]) * _LOTS[1, i]
        own ^= own >> np.uint32(15)
        own *= np.uint32(0x2C1B3C6D)
        lowest = np.minimum.reduceat(own, begins).astype(np.uint64)
        out[:, i // ROWS] = mix(out[:, i // ROWS] * np.uint64(BASES[0]) + lowest + np.uint64(i + 1))
    return out


def _shingle_sets(part: pa.RecordBatch, shingle: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text; a text of fewer words is one shingle, one without words has none."""
    words = find_words(part["text"], SPACED)
    hashes, firsts = words.digests(), words.firsts()
    own = {n: grams(hashes, n) for n in range(1, shingle + 1)}
    for begin, end in zip(firsts[:-1], firsts[1:]):
        n = min(shingle, end - begin)
        yield np.unique(own[n][begin:end - n + 1]) if n else np.zeros(0, np.uint64)


def banded(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_key, fp (the fingerprint), number (a hash of the set of shingles), size (distinct shingles) and bands of every document; no bands if size is 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = list(_shingle_sets(part, shingle))
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            number, bands = np.zeros(len(sets), np.uint64), np.zeros((0, BANDS), np.uint64)
            if len(full):
                values = np.concatenate(sets)
                begins = (np.cumsum(sizes) - sizes)[full]
                number[full] = mix(np.add.reduceat(mix(values ^ np.uint64(SEED)), begins) + sizes[full].astype(np.uint64))
                bands = _bands(values, begins)
            offsets = np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)]).astype(np.int32)
            fps = np.fromiter((fingerprint(t.as_py()) for t in part["text"]), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["text_key"], pa.array(fps.view(np.int64)), pa.array(number.view(np.int64)), pa.array(sizes.astype(np.int64)),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel().view(np.int64)))],
                ["doc_id", "text_key", "fp", "number", "size", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return arrow_map(wanted, run, f"doc_id {kind}, text_key bigint, fp bigint, number bigint, size bigint, bands array<bigint>")


def _frequent(distinct: DataFrame, count: int) -> np.ndarray:
    """Bands, sorted, that so many texts have that they must not meet in one task; each is had by at least two.

    A chunk of a task notices bands that FREQUENT of its texts have, two at least. What it does not notice of a band is less than that, so a band
    of 2 * FREQUENT of all texts, and one more for each chunk, is found. Kept are those noticed FREQUENT * count times
    or more, so there are at most BANDS / FREQUENT, which is 2 MB. The groups are the same whichever bands are found.
    """
    def notice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0

        def chunk() -> pa.RecordBatch:
            bands, n = np.unique(np.concatenate(waiting), return_counts=True)
            often = n >= max(2, FREQUENT * rows)
            return pa.RecordBatch.from_arrays([pa.array(bands[often]), pa.array(n[often])], ["bucket", "n"])

        for batch in batches:
            waiting.append(batch["bands"].flatten().to_numpy())
            rows += batch.num_rows
            if rows >= CHUNK:
                yield chunk()
                waiting, rows = [], 0
        if waiting:
            yield chunk()

    noticed = arrow_map(distinct.select("bands"), notice, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    return np.sort(noticed.filter(F.col("n") >= max(2, FREQUENT * count)).select("bucket").toPandas()["bucket"].to_numpy(np.int64))


def _groups(distinct: DataFrame, count: int) -> DataFrame:
    """Rows bucket, number: the texts (by number) that have a band in common with others.

    Frequent bands are known to be shared, so their rows need not meet. The others are dealt out by band and meet in a task.
    """
    targets = max(1, -(-count * BANDS // VARIANTS_PER_TASK))
    shared = distinct.sparkSession.sparkContext.broadcast(_frequent(distinct, count))

    def rows(batches: Iterator[pa.RecordBatch], frequent: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                part = batch.slice(at, 1 << 14)
                buckets = part["bands"].flatten().to_numpy()
                own = np.isin(buckets, known) == frequent
                numbers = np.repeat(part["number"].to_numpy(), part["bands"].value_lengths().to_numpy())
                if own.any():
                    yield buckets[own], numbers[own]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buckets, numbers in rows(batches, False):
            yield _blocks((mix(buckets.view(np.uint64)) % np.uint64(targets)).astype(np.int64), targets, buckets, numbers)

    def pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buckets, numbers in rows(batches, True):
            yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(numbers)], ["bucket", "number"])

    own = distinct.select("number", "bands")
    met = arrow_map(arrow_map(own, emit, _BLOCKS).repartitionById(targets, "target"), _crowded, "bucket bigint, number bigint")
    return met.unionByName(arrow_map(own, pass_on, "bucket bigint, number bigint"))


def _alike(own: DataFrame) -> DataFrame:
    """Rows bucket, number: the texts whose fingerprints are of one component, where these are several texts."""
    texts = written(own.filter("size > 0").select("fp", "number").distinct(), "fingerprints")
    roots = linked(written(texts.select("fp").distinct(), "distinct_fingerprints"))
    members = written(texts.join(roots, "fp").select("root", "number").distinct(), "fingerprint_components")
    several = members.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select("root")
    return members.join(several, "root").select(F.xxhash64("root", F.lit("fingerprints")).alias("bucket"), "number")


def _crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets and numbers of the buckets that hold more than one number."""
    for _, bucket, number in _gathered(batches, np.int64, np.int64):
        order = np.lexsort((number, bucket))
        bucket, number = bucket[order], number[order]
        new = _opens(bucket) | _opens(number)
        bucket, number = bucket[new], number[new]
        first = np.append(_opens(bucket), True)
        several = ~(first[:-1] & first[1:])
        yield pa.RecordBatch.from_arrays([pa.array(bucket[several]), pa.array(number[several])], ["bucket", "number"])


def _parities(values: np.ndarray) -> np.ndarray:
    """Of the values that fall to each bit, whether their number is odd. Values that two sets have in common cancel out."""
    odd = np.bincount((values % np.uint64(PARITY_WORDS * 64)).astype(np.int64), minlength=PARITY_WORDS * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _may_be_similar(size: str, parities: str, other_size: str, other_parities: str, similarity: float) -> Column:
    """False only for sets that are certainly not that similar.

    Their sizes are too far apart, or they differ in too many values: at least one for each bit of their parities that differs, where
    at most (1 - s) / (1 + s) of both sizes may be. The half stands for what is lost in doubles.
    """
    one, other = F.col(size), F.col(other_size)
    apart = sum((F.bit_count(F.col(parities)[i].bitwiseXOR(F.col(other_parities)[i])) for i in range(PARITY_WORDS)), F.lit(0))
    return (F.least(one, other) + 0.5 >= F.greatest(one, other) * similarity) & (apart * (1 + similarity) <= (one + other) * (1 - similarity) + 0.5)


def _place(text_key: str) -> Column:
    return F.pmod(F.xxhash64("doc_id", text_key), F.lit(PLACES))


def _possible(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Documents (doc_id, text, text_key) among which all rows of the given texts are, and few others while those are fewer than PLACES.

    A bitmap with a place for every hash of a text goes to the tasks that read the documents, so the other texts are not shuffled. It has
    PLACES bits however many texts there are.
    """
    spark, chunk = docs.sparkSession, 1 << 15
    place = _place("text_key")
    parts = texts.groupBy(F.floor(place / chunk).alias("part")).agg(F.bitmap_construct_agg(place % chunk).alias("bits")).collect()
    bits = np.zeros((PLACES // chunk, chunk // 8), np.uint8)
    for part in parts:
        bits[part["part"]] = np.frombuffer(part["bits"], np.uint8)
    sent = spark.sparkContext.broadcast(bits.ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            at = batch["place"].to_numpy()
            yield batch.filter(pa.array((known[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))).drop_columns(["place"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).withColumn("place", _place("text_key"))
    return arrow_map(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, text_key bigint")


def _shingles_of(docs: DataFrame, texts: DataFrame, shingle: int, parts: int) -> DataFrame:
    """number, shingles and their parities of the given texts (number, doc_id, text_key), partitioned by number; only these texts are read again."""
    needed = texts.select("number", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = list(_shingle_sets(part, shingle))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32))
            parities = np.concatenate([_parities(s) for s in sets])
            yield pa.RecordBatch.from_arrays(
                [part["number"], pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64))),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * PARITY_WORDS), pa.array(parities))],
                ["number", "shingles", "parities"])

    found = _possible(docs, texts).join(needed, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_key").eqNullSafe(F.col("_key")))
    once = found.select("number", "text").repartition(parts, "number").dropDuplicates(["number"])
    return arrow_map(once, run, "number bigint, shingles array<bigint>, parities array<bigint>")


def _exactly(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs member, centre, with whatever stands beside them, and the Jaccard similarity of their shingle sets, `exact`.

    The sets lie in buckets of their number, so pairs go to them. The sets of the centres, which are few, are written apart: a
    centre may have very many members, and Spark can split a join of two shuffled sides.
    """
    members = pairs.join(sets.select(F.col("number").alias("member"), F.col("shingles").alias("shingles_member")), "member")
    centres = written(pairs.select("centre").distinct().join(
        sets.select(F.col("number").alias("centre"), F.col("shingles").alias("shingles_centre")), "centre"), "centre_sets")
    both = F.size(F.array_intersect("shingles_member", "shingles_centre"))
    return members.join(centres, "centre").select(
        *pairs.columns, (both / (F.size("shingles_member") + F.size("shingles_centre") - both)).alias("exact"))


def _reaches(groups: DataFrame) -> DataFrame:
    """number and reach: the members of all buckets that a text is in. An original shares more bands with its copies than these with one another."""
    members = groups.groupBy("bucket").agg(F.count("*").alias("n"))
    return groups.join(members, "bucket").groupBy("number").agg(F.sum("n").alias("reach"))


def _after(state: DataFrame, found: DataFrame) -> DataFrame:
    """The state when the links found in a round (member, centre and their roots so far) are added. Components are joined by their roots."""
    merged = components(found.select(F.col("root").alias("u"), F.col("centre_root").alias("v"))).select("node", F.col("root").alias("least"))
    more = found.select(F.explode(F.array("member", "centre")).alias("end")).groupBy("end").agg(F.count("*").alias("more"))
    joined = state.join(more, state["number"] == more["end"], "left").join(merged, state["root"] == merged["node"], "left")
    return written(joined.select("number", "size", "reach", (F.col("links") + F.coalesce("more", F.lit(0).cast("bigint"))).alias("links"),
                                 F.coalesce("least", "root").alias("root")), "states")


def _joined(groups: DataFrame, sizes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """node and root of all texts: two that share a bucket and are that similar have the same root.

    In each round some members of a bucket, its centres, are compared with all others of the bucket that are not of their component yet. Then
    they are done with and leave the bucket, and a bucket whose members are all of one component is done with. So in the end any two
    members of a bucket have been compared or are of one component. Centres are the members with most links so far, at first those of the
    largest reach; there are four times as many in every round, so even where no two are similar the rounds grow with the logarithm of the members.

    From the second round on a bucket with few members outside its largest component, LAST times the centres at most, has all of these as
    centres and is done with: their pairs have to be compared in any case, and each round costs jobs of its own however little it compares.
    """
    state = sizes.select("number", "size", "reach", F.lit(0).cast("bigint").alias("links"), F.col("number").alias("root"))
    tested: DataFrame | None = None
    centres, last = 1, 0
    while True:
        members = groups.join(state, "number")
        kinds = members.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(
            F.count("*").alias("kinds"), F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("main"))
        several = kinds.filter("kinds > 1").select("bucket", F.col("main.root").alias("main"), (F.col("n") - F.col("main.n")).alias("others"))
        ends = F.col("others") <= last
        rank = F.struct((ends & (F.col("root") == F.col("main"))).alias("late"), (-F.col("links")).alias("less"), (-F.col("reach")).alias("narrow"),
                        F.xxhash64("number").alias("lot"), "number")
        members = written(members.join(several, "bucket").select(
            "bucket", "number", "size", "root", rank.alias("rank"), F.when(ends, F.col("others")).otherwise(centres).alias("wanted")), "open_groups")
        if members.isEmpty():
            return state.select(F.col("number").alias("node"), "root")
        # The parities come along only where pairs are made, so a pair that is certainly not similar is no row.
        wide = members.join(sets.select("number", "parities"), "number")
        place = F.row_number().over(Window.partitionBy("bucket").orderBy("rank"))
        # The bound that is the same for all buckets reaches the map side.
        first = (members.withColumn("place", place).filter((F.col("place") <= max(centres, last)) & (F.col("place") <= F.col("wanted")))
                 .join(sets.select("number", "parities"), "number"))
        chosen = written(first.select("bucket", *(F.col(c).alias(n) for c, n in (
            ("number", "centre"), ("root", "centre_root"), ("size", "centre_size"), ("rank", "centre_rank"), ("parities", "centre_parities")))), "centres")
        pairs = (wide.join(chosen, "bucket").filter("root <> centre_root AND centre_rank < rank")
                 .filter(_may_be_similar("size", "parities", "centre_size", "centre_parities", similarity))
                 .select(F.col("number").alias("member"), "centre", "root", "centre_root").distinct())
        if tested is not None:
            before = tested.select(F.least("member", "centre").alias("one"), F.greatest("member", "centre").alias("other"))
            pairs = pairs.join(before, (F.least("member", "centre") == F.col("one")) & (F.greatest("member", "centre") == F.col("other")), "left_anti")
        pairs = written(pairs, "pairs")
        if not pairs.isEmpty():
            compared = written(_exactly(pairs, sets), "compared_pairs")
            tested = compared if tested is None else tested.unionByName(compared)
            found = compared.filter(F.col("exact") >= similarity)
            if not found.isEmpty():
                state = _after(state, found)
        groups = members.join(chosen.select(F.col("bucket").alias("_bucket"), "centre"),
                              (F.col("bucket") == F.col("_bucket")) & (F.col("number") == F.col("centre")), "left_anti").select("bucket", "number")
        centres *= 4
        last = LAST * centres


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id: documents joined by pairs of texts whose shingles are that similar.

    Candidates are the components of fingerprints within RADIUS bits, as in `near_duplicates`, and the texts that share a band.
    """
    own = written(banded(docs, shingle), "banded_texts")
    text = F.struct("doc_id", "text_key")
    distinct = written(own.groupBy("number").agg(
        F.first("bands").alias("bands"), F.first("size").alias("size"), F.min("doc_id").alias("first_id"),
        F.min(text).alias("text")), "distinct_texts")
    groups = written(_alike(own).unionByName(_groups(distinct, distinct.count())), "groups")
    texts = written(distinct.join(groups.select("number").distinct(), "number").select("number", "size", "text.*"), "grouped_texts")
    spark = docs.sparkSession
    shingles = texts.agg(F.sum("size")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shingles // SHINGLES_PER_BUCKET))
    with bucketed(_shingles_of(docs, texts, shingle, parts), "shingle_sets", "number", parts) as sets:
        sizes = written(texts.select("number", "size").join(_reaches(groups), "number"), "reaches")
        members = _joined(groups, sizes, sets, similarity)
    joined = distinct.join(members, distinct["number"] == members["node"], "left").select(
        "number", "first_id", F.coalesce("root", "number").alias("root"))
    smallest = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return own.join(joined.join(smallest, "root").select("number", "component_id"), "number").select("doc_id", "component_id")
