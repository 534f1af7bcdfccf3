"""Near duplicates among texts by min-max hashing of word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from inkprint.llm.common import components, mix, span_hashes
from inkprint.session import broadcast_if_small, settle, spread

WORDS = 5
PERCENT = 75
ROWS, BANDS = 4, 32  # values in a band, half of them minima, half maxima
PIVOT_ROUNDS = 2  # how often the members of large buckets that stay open meet a new pivot
WITHIN = (6, 64)  # longer keys for texts that could link by what they have of their pivot alone
FINER = ((6, 64), (10, 200))  # longer keys for the members of buckets that are large after that
PAIRS_PER_MEMBER = 16
CARRIED = ("key", "size", "shared", "component", "pivot", "common")
CLASS_ROWS = 512  # texts that meet one copy of their pivot
STEPS = 256  # steps of a pivot's size in which sizes and intersections are summed up
MAX_BROADCAST_ROWS = 20_000


def normalised(text: str) -> bytes:
    """Words between ASCII white space, A-Z in lower case, with one space between."""
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split())


def shingles(data: bytes, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of all runs of `words` words; of the whole sequence if it is shorter; none without words."""
    if not data:
        return np.empty(0, np.uint64)
    letters = np.frombuffer(data, np.uint8)
    spaces = np.flatnonzero(letters == 32)
    starts, ends = np.append(0, spaces + 1), np.append(spaces, len(letters))
    if len(starts) < words:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[:len(starts) - words + 1], ends[words - 1:]
    return np.unique(span_hashes(letters, starts, ends))


def _permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    top = np.iinfo(np.uint64).max
    return draw.integers(0, top, count, np.uint64, True) | np.uint64(1), draw.integers(0, top, count, np.uint64, True)


def band_keys(found: np.ndarray, bands: int, rows: int, seed: int) -> np.ndarray:
    """One 64-bit key per band from minima and maxima: each permutation is evaluated once and gives two values."""
    need = bands * rows
    factor, shift = _permutations(-(-need // 2), seed)
    low, high = np.full(len(factor), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(factor), np.uint64)
    for at in range(0, len(found), 512):
        value = (found[at:at + 512, None] ^ shift) * factor
        np.minimum(low, value.min(0), out=low)
        np.maximum(high, value.max(0), out=high)
    values = np.stack([low, high], 1).reshape(-1)[:need].reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, i])
    return key.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, sizes, bands = [], [], []
        for text in batch.column("text"):
            data = normalised(text.as_py() or "")
            found = shingles(data)
            keys.append(hashlib.blake2b(data, digest_size=16).digest() if data else None)
            sizes.append(len(found))
            bands.append(band_keys(found, BANDS, ROWS, 1) if data else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
             pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "key", "n_shingles", "bands"])


def _finer(rows: int, bands: int, seed: int, carried: tuple[str, ...] = CARRIED) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [band_keys(shingles(t.as_py()), bands, rows, seed) for t in batch.column("data")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), pa.array(keys, pa.list_(pa.int64()))], names=[*carried, "bands"])

    return run


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The size of a text's pivot, how many shingles both have in common, whether they link, and the shingles that only
    the text has, a part of the batch at a time."""
    known: dict[bytes, np.ndarray] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part, sizes, common, ok, outside = batch.slice(at, 256), [], [], [], []
            for a, b in zip(part.column("data"), part.column("data_pivot"), strict=True):
                data, found = b.as_py(), shingles(a.as_py())
                if data not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[data] = shingles(data)
                rest = np.setdiff1d(found, known[data], assume_unique=True)
                both = len(found) - len(rest)
                sizes.append(len(known[data]))
                common.append(both)
                ok.append(100 * both >= PERCENT * (len(found) + len(known[data]) - both))
                outside.append(rest.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("pivot", "key", "size", "component", "in_pivot")), pa.array(sizes, pa.int64()),
                 pa.array(common, pa.int64()), pa.array(ok, pa.bool_()), pa.array(outside, pa.list_(pa.int64()))],
                names=["pivot", "key", "size", "component", "in_pivot", "size_pivot", "common", "ok", "outside"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, shingle) of every text, a part of the batch at a time."""
    for batch in batches:
        keys = batch.column("key").to_pylist()
        for at in range(0, len(keys), 256):
            sets = [shingles(t.as_py()) for t in batch.column("data").slice(at, 256)]
            owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[at:at + 256], pa.binary()).take(pa.array(owner)),
                 pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64))], names=["key", "shingle"])


def _alone(texts: DataFrame) -> DataFrame:
    """(key, alone): how many shingles of a text no other candidate has. They are in no intersection, so sets x and y
    have at most min(size - alone) of the two in common."""
    rows = texts.mapInArrow(_opened, "key binary, shingle bigint")
    again = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.first("key").alias("key"))
    alone = again.where("n = 1").groupBy("key").agg(F.count("*").alias("alone"))
    return texts.select("key").join(alone, "key", "left").select("key", F.coalesce("alone", F.lit(0)).alias("alone"))


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = [normalised(t.as_py()) for t in batch.column("text")]
        keys = [hashlib.blake2b(d, digest_size=16).digest() for d in data]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(data, pa.binary())], names=["key", "data"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare full sets. The sets of the texts seen last are kept: most pairs have a leader in common."""
    known: dict[bytes, np.ndarray] = {}

    def of(data: bytes) -> np.ndarray:
        found = known.get(data)
        if found is None:
            if len(known) >= 64:
                known.clear()
            found = known[data] = shingles(data)
        return found

    for batch in batches:
        common, ok = [], []
        for a, b in zip(batch.column("data_a"), batch.column("data_b"), strict=True):
            one, other = of(a.as_py()), of(b.as_py())
            both = len(np.intersect1d(one, other, assume_unique=True))
            common.append(both)
            ok.append(100 * both >= PERCENT * (len(one) + len(other) - both))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("a", "b", "in_a", "in_b")), pa.array(common, pa.int64()), pa.array(ok, pa.bool_())],
            names=["a", "b", "in_a", "in_b", "common", "ok"])


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, in_a, in_b, common, ok): pairs of texts, the components they were in, how many shingles they have in common
    and whether they link."""
    left = texts.select(F.col("key").alias("a"), F.col("data").alias("data_a"))
    right = texts.select(F.col("key").alias("b"), F.col("data").alias("data_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "in_a", "in_b", "data_a", "data_b")
    return settle(both.mapInArrow(
        _confirm, "a binary, b binary, in_a binary, in_b binary, common bigint, ok boolean"))


def _members(signed: DataFrame) -> DataFrame:
    """(bucket, key, size, central and what else `signed` has) of all buckets with two members or more; where components
    are known, with two components or more. `central` is how many members a text meets in all its buckets: the text that
    a group of near copies was made from meets the most."""
    opened = signed.withColumn("bucket", F.explode("bands")).drop("bands")
    full = opened.groupBy("bucket")
    if "component" in signed.columns:
        full = full.agg(F.count("*").alias("s"), F.min("component").alias("low"), F.max("component").alias("high")).where(
            "low <> high").select("bucket", "s")
    else:
        full = full.agg(F.count("*").alias("s")).where("s > 1")
    met = settle(opened.join(full, "bucket"))
    central = met.groupBy("key").agg(F.sum("s").alias("central"))
    return settle(met.drop("s").join(central, "key"))


def _with_leader(members: DataFrame) -> DataFrame:
    """Pairs of the members of each bucket with its most central one, where these are not in one component yet."""
    lead = members.groupBy("bucket").agg(F.max_by(
        F.struct(*CARRIED), F.struct("central", "key")).alias("lead"))
    star = members.join(lead, "bucket").where("component <> lead.component").where(
        _possible(*(F.col(f"lead.{c}") for c in ("size", "shared", "pivot", "common"))))
    ends = F.struct("key", "component"), F.struct("lead.key", "lead.component")
    star = star.select(F.least(*ends).alias("low"), F.greatest(*ends).alias("high"))
    return star.select(F.col("low.key").alias("a"), F.col("high.key").alias("b"),
                       F.col("low.component").alias("in_a"), F.col("high.component").alias("in_b"))


def _open(named: DataFrame) -> tuple[DataFrame, bool, bool]:
    """(bucket, main, few): buckets with several components, the component with the most members, and whether the pairs
    across components are few for the number of members. Then whether there is any such bucket and whether some have to
    be taken further: none if the pairs of all buckets are few for all members."""
    parts = named.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    sums = parts.groupBy("bucket").agg(
        F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"), F.count("*").alias("parts"),
        F.max_by("component", F.struct("n", "component")).alias("main")).where("parts > 1")
    pairs = (F.col("s") * F.col("s") - F.col("q")) / 2
    several = settle(sums.select("bucket", "main", "s", pairs.alias("pairs"), (
        pairs <= F.lit(PAIRS_PER_MEMBER) * F.col("s")).alias("few")))
    n, rows, listed, large = several.agg(
        F.count("*"), F.sum("s"), F.sum("pairs"), F.max((~F.col("few")).cast("int"))).first()
    few = not large or 2 * listed <= PAIRS_PER_MEMBER * rows
    return several.select("bucket", "main", "few"), n > 0, not few


def _across(near: DataFrame) -> DataFrame:
    """All pairs of members of a bucket that are not in one component. One of the two is outside the main one."""
    numbers = ("size", "shared", "pivot", "common")
    other = near.select("bucket", F.col("key").alias("b"), F.col("component").alias("in_b"),
                        *(F.col(c).alias(f"{c}_b") for c in numbers))
    met = near.where("component <> main").join(other, "bucket").where(
        "component <> in_b and (in_b = main or key < b)").where(_possible(*(F.col(f"{c}_b") for c in numbers)))
    ends = F.struct("key", "component"), F.struct(F.col("b").alias("key"), F.col("in_b").alias("component"))
    met = met.select(F.least(*ends).alias("low"), F.greatest(*ends).alias("high"))
    return met.select(F.col("low.key").alias("a"), F.col("high.key").alias("b"),
                      F.col("low.component").alias("in_a"), F.col("high.component").alias("in_b"))


def _new(pairs: DataFrame, tested: DataFrame | None) -> DataFrame:
    """Each pair once, without those compared before."""
    pairs = pairs.distinct()
    return pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")


def _grown(groups: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after more links between components, each named by its smallest text. A text without any link
    need not be in `groups`."""
    small = links.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    merged = settle(components(links, "in_a", "in_b", small))
    if groups is None:
        return merged
    further = broadcast_if_small(merged.select(F.col("node").alias("component"), F.col("component").alias("into")),
                                 MAX_BROADCAST_ROWS)
    old = groups.join(further, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    return settle(old.unionByName(merged.join(groups, "node", "left_anti")))


def _named(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
    """`rows` with the component of each text in place of an earlier one."""
    if groups is None:
        return rows.withColumn("component", F.col("key"))
    of = groups.select(F.col("node").alias("key"), F.col("component").alias("_found"))
    return rows.drop("component").join(of, "key", "left").withColumn(
        "component", F.coalesce("_found", "key")).drop("_found")


def _classes(near: DataFrame) -> DataFrame:
    """(pivot, key, size, component, in_pivot): every bucket gets one pivot, and each text meets the pivots of its
    buckets. A text follows the most central leader of its buckets and a bucket the most central one that a member
    follows, so a group has few pivots."""
    rank = F.struct("central", "key", "component")
    lead = settle(near.groupBy("bucket").agg(F.max(rank).alias("lead")))
    first = near.select("bucket", "key").join(broadcast_if_small(lead, MAX_BROADCAST_ROWS), "bucket").groupBy("key").agg(
        F.max("lead").alias("first"))
    chosen = near.select("bucket", "key").join(first, "key").groupBy("bucket").agg(F.max("first").alias("pivot"))
    chosen = chosen.select("bucket", F.col("pivot.key").alias("pivot"), F.col("pivot.component").alias("in_pivot"))
    return settle(near.select("bucket", "key", "size", "component").join(
        broadcast_if_small(settle(chosen), MAX_BROADCAST_ROWS), "bucket").drop("bucket").distinct())


def _with_pivots(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Every text of a class beside its pivot, of which large classes get several copies."""
    parts = settle(classes.groupBy("pivot").agg(F.ceil(F.count("*") / CLASS_ROWS).cast("int").alias("parts")))
    parts = broadcast_if_small(parts, MAX_BROADCAST_ROWS)
    copies = texts.select(F.col("key").alias("pivot"), F.col("data").alias("data_pivot")).join(parts, "pivot").select(
        "pivot", "data_pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = classes.join(parts, "pivot").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    both = texts.join(broadcast_if_small(dealt, MAX_BROADCAST_ROWS), "key").join(copies, ["pivot", "part"]).select(
        *classes.columns, "data", "data_pivot")
    return settle(both.select("pivot", "key", "size", "component", "in_pivot", "data", "data_pivot").mapInArrow(
        _beside, "pivot binary, key binary, size bigint, component binary, in_pivot binary, size_pivot bigint, "
        "common bigint, ok boolean, outside array<bigint>"))


def _around_pivots(beside: DataFrame, texts: DataFrame, seed: int) -> DataFrame:
    """The members of the next buckets of texts that were compared with the pivots of their classes.

    Two texts of a class have no more of their pivot in common than either has of it. If that does not reach the
    threshold, they can link only by shingles outside of the pivot that both have: these are buckets, exactly, and only
    those that several components have. Texts that could link with another component by what they have of the pivot
    alone get longer keys besides. Whether a text could is read off sums of its class by steps of size and of
    intersection, which never rule out too much."""
    opened = beside.select("pivot", "key", "component", F.explode("outside").alias("value"))
    apart = opened.groupBy("pivot", "value").agg(F.min("component").alias("low"), F.max("component").alias("high")).where(
        "low <> high").select("pivot", "value")
    met = settle(opened.join(apart, ["pivot", "value"]).select("pivot", "key", "value"))
    number = met.groupBy("pivot", "key").agg(F.count("*").alias("n"))
    rows = settle(beside.drop("outside", "in_pivot", "ok").join(number, ["pivot", "key"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0))))

    at = [F.least(F.floor(F.col(c) * STEPS / F.col("size_pivot")), F.lit(4 * STEPS)).alias(f"{c}_step")
          for c in ("size", "common")]
    sums = rows.groupBy("pivot", *at).agg(
        F.min("size").alias("least_size"), F.max("common").alias("most_common"), F.max("n").alias("most"),
        F.min("component").alias("low"), F.max("component").alias("high"))
    sums = broadcast_if_small(settle(sums.drop("size_step", "common_step").withColumnRenamed("pivot", "of")),
                              MAX_BROADCAST_ROWS)
    same = (F.col("pivot") == F.col("of")) & ((F.col("low") != F.col("component")) | (F.col("high") != F.col("component")))
    reach = F.least("common", "most_common")
    enough = lambda most: 100 * most >= PERCENT * (F.col("size") + F.col("least_size") - most)
    able = settle(rows.join(sums, same & enough(reach + F.least("n", "most")), "left_semi"))
    within = able.join(sums, same & enough(reach), "left_semi").select("pivot", "key")
    length, bands = WITHIN
    longer = within.join(texts, "key").select("pivot", "key", "data").mapInArrow(
        _finer(length, bands, seed, ("pivot", "key")), "pivot binary, key binary, bands array<bigint>")
    values = met.unionByName(longer.select("pivot", "key", F.explode("bands").alias("value")))
    return settle(values.join(able, ["pivot", "key"]).select(
        F.xxhash64("pivot", "value").alias("bucket"), "key", "size", (F.col("common") + F.col("n")).alias("shared"),
        "component", "pivot", "common", F.col("common").alias("central")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept. Documents link when 100 * |A and B| >= 75 * |A or B|
    over their sets of distinct 5-word shingles; a component is named by its smallest id.

    Documents with the same word sequence form one class. A class has a min-max signature: 64 permutations, each
    evaluated once and giving its minimum and its maximum, in 32 bands of 4. Two sets at the threshold share no band with
    a probability of about 5 in 10^6. All members of a bucket are compared with its most central member, on full sets.
    Buckets that then still hold several components compare the pairs across components, where these are few. The members
    of larger ones are classed by pivots, central members, and compared with these; two texts of a class that have too
    little of the pivot to link by that alone must share shingles outside of it, which make their next buckets. These are
    treated in the same way. After some rounds members of buckets that are still large get longer keys (64 of 6 values,
    then 200 of 10), and only then all pairs across components. So a large group of copies costs about one comparison per
    member and band once, and no step but the last lists all pairs of a group. Shingles that only one candidate has bound
    every intersection from above, and so does what both texts have in common with a pivot; texts and pairs that cannot
    reach the threshold by this bound are not compared.

    Defined cases: a text without words or a null has the size 0 and no link; fewer than five words are one shingle; a
    null id links with nothing and is kept; rows that repeat an id are one document if their words agree, else separate
    texts with one name; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = spread(rows, "doc_id")
    signed = settle(rows.mapInArrow(_signatures, "doc_id bigint, key binary, n_shingles bigint, bands array<bigint>"))
    usable = signed.where("key is not null and doc_id is not null")
    classes = settle(usable.groupBy("key").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("size"),
                                               F.first("bands").alias("bands")))
    opened = classes.select(F.explode("bands").alias("bucket"), "key", "first")
    full = opened.groupBy("bucket").agg(F.count("*").alias("s")).where("s > 1").select("bucket")
    wanted = opened.join(full, "bucket").select("first").distinct()
    texts = docs.select(F.col(id_col).cast("bigint").alias("first"), F.col(text_col).alias("text")).where(
        "text is not null").join(wanted, "first", "left_semi").select("text")
    texts = settle(texts.mapInArrow(_normalise, "key binary, data binary").groupBy("key").agg(
        F.first("data").alias("data")))

    alone = _alone(texts)
    able = classes.join(alone, "key").withColumn("shared", F.col("size") - F.col("alone"))
    able = settle(able.where(f"100 * shared >= {PERCENT} * size").select("key", "size", "shared", "bands"))
    # Until the first links every text is a component of its own.
    members = _members(able)
    members = members.select("*", F.col("key").alias("component"), F.lit(None).cast("binary").alias("pivot"),
                             F.lit(None).cast("bigint").alias("common"))
    tested = groups = pivots = own = None

    def compare(pairs: DataFrame, texts: DataFrame) -> bool:
        nonlocal tested
        found = _confirmed(_new(pairs, tested), texts)
        return grow(found)

    def grow(found: DataFrame) -> bool:
        nonlocal tested, groups
        pairs = found.select("a", "b")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found.where("ok and in_a <> in_b").select("in_a", "in_b")
        if links.isEmpty():
            return False
        groups = _grown(groups, links)
        return True

    steps = [None] * PIVOT_ROUNDS + list(FINER)
    for at, step in enumerate([*steps, None]):
        # Buckets of keys have leaders, those of shingles outside of a pivot were made after the comparison with it.
        if (at == 0 or at > PIVOT_ROUNDS) and compare(_with_leader(members), own or texts):
            members = settle(_named(members, groups))
        several, some, further = _open(members)
        if not some:
            break
        last = at == len(steps) or not further
        grown = compare(_across(members.join(several if last else several.where("few"), "bucket")), own or texts)
        large = several.where("not few").select("bucket")
        if last:
            break
        near = members.join(large, "bucket")
        near = settle(_named(near, groups) if grown else near)
        if own is None:
            own = settle(texts.join(broadcast_if_small(settle(near.select("key").distinct()), MAX_BROADCAST_ROWS),
                                    "key", "left_semi"))
        if step is None:
            pivots = _with_pivots(_classes(near), own)
            linked = grow(pivots.select(F.least("pivot", "key").alias("a"), F.greatest("pivot", "key").alias("b"),
                                        F.col("component").alias("in_a"), F.col("in_pivot").alias("in_b"), "ok"))
            members = _around_pivots(_named(pivots, groups) if linked else pivots, own, at + 11)
            continue
        if at == PIVOT_ROUNDS:
            pivots = pivots.groupBy("key").agg(F.max_by(F.struct("pivot", "common"), F.struct("common", "pivot")).alias("p"))
            pivots = settle(pivots.select("key", "p.pivot", "p.common"))
        still = _named(near.select("key").distinct(), groups).join(able.select("key", "size", "shared"), "key").join(
            pivots, "key", "left")
        length, bands = step
        members = _members(settle(own.join(still, "key").select(*CARRIED, "data").mapInArrow(
            _finer(length, bands, at + 2), "key binary, size bigint, shared bigint, component binary, pivot binary, "
            "common bigint, bands array<bigint>")))
    linked = classes.select("key", "first", F.col("key").alias("component"))
    if groups is not None:
        linked = classes.select("key", "first").join(groups, F.col("key") == F.col("node"), "left").select(
            "key", "first", F.coalesce("component", "key").alias("component"))
    names = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    of_key = linked.join(names, "component").select("key", "component_id")
    out = signed.select("doc_id", "key", "n_shingles").join(of_key, "key", "left").select(
        F.col("doc_id").alias(id_col), "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _possible(size: Column, shared: Column, pivot: Column, common: Column) -> Column:
    """The largest possible intersection reaches the threshold; the arguments are the other text's columns. Two texts that
    were both compared with a third one, the pivot, have some of `common` with it and with each other, and outside of it
    only shingles that are in `shared` but not in `common`."""
    outside = F.least(F.col("shared") - F.col("common"), shared - common)
    most = F.when(F.col("pivot") == pivot, F.least("common", common) + outside).otherwise(F.least("shared", shared))
    return 100 * most >= PERCENT * (F.col("size") + size - most)
