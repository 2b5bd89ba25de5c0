"""MinHash near-duplicates with sequential Bayesian verification.

A text's set is its distinct shingles of words. Texts with one and the same set are a
class; everything below is done once for each class. MinHash signatures are cut into bands;
classes that agree on a band share a bucket. Buckets that share a class are drawn together
into a family (two rounds of smallest labels), so that a text travels to few places.

Within a family, pairs are compared batch by batch of their signatures: after each batch the
posterior of a similarity at or over the threshold, given the matches so far, must not be
below ``miss``, or the pair is dropped. What survives is verified on the full sets. Pairs that are
already linked through others are skipped, and a family yields a star for each component
found, never all pairs. A family that is too large for a task is cut into blocks, and each
pair of blocks is a task of its own. Components of the stars are then found over all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import cache, partial
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from leafmill.llm.common import BASE, Batches, Rolling, as_bytes, components, may_hold, mix, row_key, shared_table, slices

BANDS, ROWS = 36, 5
HASHES = BANDS * ROWS
#: Signature values compared at a time, and the probability of a false drop at each batch.
BATCH, MISS = 20, 1e-9
_RANDOM = np.random.Generator(np.random.PCG64(911))
_A = _RANDOM.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 2**64, HASHES, dtype=np.uint64)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def shingles(text: bytes, width: int) -> np.ndarray:
    """64-bit hashes of the distinct shingles, sorted; of all words if there are fewer."""
    data = np.frombuffer(text.translate(_LOWER), np.uint8)
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~_BLANK[data]
    starts, ends = np.flatnonzero(word[1:-1] & ~word[:-2]), np.flatnonzero(word[1:-1] & ~word[2:]) + 1
    if not len(starts):
        return np.zeros(0, np.uint64)
    words = Rolling(data).of(starts, ends) + (ends - starts).astype(np.uint64) * BASE
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * BASE + words[i : len(words) - n + 1 + i])
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 2**64 - 1, np.uint64)
    for low in range(0, len(hashes), 1024):
        np.minimum(out, (hashes[low : low + 1024, None] * _A + _B).min(0), out=out)
    return out


def band_keys(sign: np.ndarray) -> np.ndarray:
    rows = sign.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        out = mix(out * BASE + rows[:, j])
    return out.view(np.int64)


@cache
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """After each batch, the matches below which the posterior of the threshold is under ``miss``.

    With an even prior the posterior is a beta distribution, and its upper tail a binomial sum.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def _sets(batches: Batches, kind: pa.DataType, width: int):
    for rows in slices(batches, "text"):
        n, keys, bands = [], [], []
        for text in as_bytes(rows.column("text")):
            found = shingles(text, width)
            n.append(len(found))
            keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
            bands.append(band_keys(signature(found)) if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [rows.column("id"), rows.column("key"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            names=["id", "key", "n", "class", "bands"],
        )


def families(classes: DataFrame, block_rows: int, block_shingles: int) -> DataFrame:
    """(family, i, j, block, class, key): where each class is compared, and which blocks there."""
    buckets = classes.select("class", F.explode("bands").alias("bucket"))
    # Written first: a join of two plain shuffles can split a large bucket.
    shared = shared_table(buckets.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1").select("bucket"), "shared")
    members = shared_table(buckets.join(shared, "bucket"), "buckets")
    label = members.groupBy("class").agg(F.min("bucket").alias("label"))
    for _ in range(2):
        of_bucket = members.join(label, "class").groupBy("bucket").agg(F.min("label").alias("family"))
        label = members.join(of_bucket, "bucket").groupBy("class").agg(F.min("family").alias("label"))
    placed = members.join(of_bucket, "bucket").select("family", "class").distinct()
    placed = shared_table(placed.join(classes.select("class", "n", F.col("best.key").alias("key")), "class"), "families")
    sizes = placed.groupBy("family").agg(F.count("*").alias("rows"), F.sum("n").alias("total")).filter("rows > 1")
    blocks = F.ceil(F.greatest(F.col("rows") / block_rows, F.col("total") / block_shingles)).cast("int")
    placed = placed.join(sizes.select("family", blocks.alias("blocks")), "family")
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    placed = placed.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.select(
        "family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class", "key"
    )


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))
        self.root = np.arange(n)  # kept flat: the root of every node

    def link(self, a: int, b: int) -> None:
        x, y = int(self.root[a]), int(self.root[b])
        self.root[self.root == max(x, y)] = min(x, y)


def links(sets: list[np.ndarray], block: np.ndarray, i: int, j: int, percent: int, miss: float) -> np.ndarray:
    """The root of every member after all pairs at or over the threshold are linked.

    With i and j different, only pairs across the two blocks are compared.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    signs = np.array([signature(s) for s in sets])
    least = least_matches(percent / 100, miss)
    forest = _Forest(n)
    full: dict[int, set[int]] = {}

    def as_set(k: int) -> set[int]:
        if k not in full:
            full[k] = set(sets[k].tolist())
        return full[k]

    for a in range(n - 1):
        near = np.arange(a + 1, n)
        low, high = np.minimum(sizes[near], sizes[a]), np.maximum(sizes[near], sizes[a])
        ok = (100 * low >= percent * high) & (forest.root[near] != forest.root[a])
        if i != j:
            ok &= block[near] != block[a]
        near = near[ok]
        matches = np.zeros(len(near), np.int64)
        for k, need in enumerate(least):
            if not len(near):
                break
            part = slice(k * BATCH, (k + 1) * BATCH)
            matches += (signs[near, part] == signs[a, part]).sum(1)
            ok = matches >= need
            near, matches = near[ok], matches[ok]
        for b in near[np.argsort(-matches, kind="stable")].tolist():
            if forest.root[a] != forest.root[b]:
                both = len(as_set(a) & as_set(b))
                if 100 * both >= percent * (int(sizes[a] + sizes[b]) - both):
                    forest.link(a, b)
    return forest.root


def _verify(batches: Batches, width: int, percent: int, miss: float):
    names = ("family", "i", "j", "block", "class")
    group, classes, blocks, sets = None, [], [], []

    def stars() -> pa.RecordBatch:
        roots = links(sets, np.array(blocks), group[1], group[2], percent, miss)
        out = [(classes[r], classes[m]) for m, r in enumerate(roots.tolist()) if r != m]
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

    for rows in batches:
        columns = [rows.column(c).to_pylist() for c in names]
        for *place, block, kind, text in zip(*columns, as_bytes(rows.column("text")), strict=True):
            if place != group:
                if len(sets) > 1:
                    yield stars()
                group, classes, blocks, sets = place, [], [], []
            if classes and classes[-1] == kind:  # a repeated row
                continue
            found = shingles(text, width)
            if hashlib.blake2b(found.tobytes(), digest_size=16).digest() == kind:
                classes.append(kind)
                blocks.append(block)
                sets.append(found)
    if len(sets) > 1:
        yield stars()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    miss: float = MISS,
    block_rows: int = 800,
    block_shingles: int = 2_000_000,
) -> DataFrame:
    """Every row's component: id, key, n_shingles, component_id, kept, chosen.

    Texts are linked if ``100 * intersection >= percent * union`` of their sets of
    ``width``-word shingles (words: A-Z in lower case, cut at blanks; fewer words are one
    shingle). ``component_id`` is the smallest id that can be reached, itself included; ``kept``
    is whether that is the row's own. Texts that are null or have no words are linked with
    nothing. Rows without an id sort last; a component of such rows alone has a null id.
    ``key`` is a hash of id and text; ``chosen`` marks the rows of one key in each component
    (more than one row only if id and text are repeated). An empty table gives no rows;
    other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("key", row_key("id", "text"))
    kind = rows.schema["id"].dataType
    sets = shared_table(
        rows.mapInArrow(
            partial(_sets, kind=to_arrow_type(kind), width=width),
            f"id {kind.simpleString()}, key long, n long, class binary, bands array<long>",
        ),
        "sets",
    )
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("best")
    classes = shared_table(
        sets.filter("class is not null").groupBy("class").agg(best, F.first("n").alias("n"), F.first("bands").alias("bands")), "classes"
    )
    places = shared_table(families(classes, block_rows, block_shingles), "places")
    texts = places.join(may_hold(rows.select("key", "text"), places, "held").filter("held").drop("held"), "key").drop("key")
    edges = (
        texts.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "block", "class")
        .mapInArrow(partial(_verify, width=width, percent=percent, miss=miss), "a binary, b binary")
    )
    labels = components(edges)
    whole = classes.select("class", "best").join(labels, F.col("class") == F.col("node"), "left")
    linked = whole.filter("label is not null").groupBy("label").agg(F.min("best").alias("first"))
    owner = whole.join(linked, "label", "left").select("class", F.coalesce("first", "best").alias("owner"))
    out = sets.select("id", "key", "n", "class").join(owner, "class", "left")
    own = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    owner_ = F.coalesce("owner", own)
    return out.select(
        "id", "key", F.col("n").alias("n_shingles"), owner_["id"].alias("component_id"),
        F.col("id").eqNullSafe(owner_["id"]).alias("kept"), (F.col("key") == owner_["key"]).alias("chosen"),
    )


def keep_one(docs: DataFrame, found: DataFrame, carry: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all its columns.

    Most rows have a key of their own and stay; they pass by. Only rows whose key may be
    dropped or repeated are joined to what ``found`` says of it.
    """
    keys = found.groupBy("key").agg(F.count("*").alias("copies"), F.max("chosen").alias("stays"))
    special = shared_table(keys.filter("copies > 1 or not stays"), "special")
    rows = may_hold(
        docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), row_key(id_col, text_col).alias("key")), special, "held"
    )
    judged = rows.filter("held").join(special, "key", "left")
    once = rows.filter("not held").select("row").unionByName(judged.filter("copies is null").select("row"))
    repeated = judged.filter("stays").dropDuplicates(["key"]).select("row")
    return once.unionByName(repeated).select(*(F.col("row").getField(c).alias(c) for c in carry))
