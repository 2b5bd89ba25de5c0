"""The trie of conversation prefixes, with totals of all subtrees.

Method: depth-band rollup. Bands of ``BAND`` depths cut the trie into small trees. Inside a band every
node explodes to its ancestors of the band only (at most ``BAND`` rows), and sums combine before
they are shuffled. That completes the bands' own totals. The totals of band roots are then
completed across bands: a root's ancestors among the roots are reached by doubling, so k bands
take log2(k) rounds. At last each completed root explodes once to the ancestors in the band
above it. Neither a deep conversation nor a bushy node makes more than ``BAND`` rows of a node.

A node is a sequence of turns. Its key is a polynomial in the digests of its turns modulo the
prime 2^127 - 1 (two different sequences share a key with a chance of about 2^-120), which has two
uses: equal prefixes meet by key without their texts, and a stretch of turns acts on the key
before it as one linear map, so that a conversation may lie in many partitions. Rows are range-
partitioned by (conversation, turn); a partition's first stretch is summed up as such a map, the
driver joins these maps (one short row for each partition), and a second pass begins every
partition where the one before it ended.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm.common import Batches, batch, shared_table

#: Depths of a band.
BAND = 16
_PRIME = (1 << 127) - 1
#: Base of the polynomial (any number of that size will do; it decides nothing but the keys).
_BASE = 0x5851F42D4C957F2D14057B7EF767814F % _PRIME


def _symbol(digest: bytes) -> int:
    return int.from_bytes(digest[:15], "big") + 1


def _turns(table: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, head, digest, chars) of every row; the text itself goes no further."""
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    return table.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), role_.alias("role"), F.substring(text_, 1, 32).alias("head"),
        F.substring(F.unhex(F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_), 256)), 1, 16).alias("digest"),
        F.char_length(text_).cast("long").alias("chars"),
    )


_ORDER = ["turn", "role", "head", "digest"]


def _headers(turns: DataFrame, base: Column, taken: Column, most: int) -> DataFrame:
    """One row for each conversation: how many turns it has, how many of them are skipped, and the
    turns of its base that it begins with (at most ``most``)."""
    convs = turns.groupBy("conv").agg(F.count("*").alias("own")).select("conv", "own", base.alias("base"), taken.cast("int").alias("taken"))
    first = W.partitionBy("conv").orderBy(*_ORDER)
    heads = (
        turns.where(F.col("conv") == base).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)
        .groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("rank", "digest", "chars"))).alias("heads"))
    )
    begin = F.slice(F.coalesce("heads", F.array().cast(heads.schema["heads"].dataType)), 1, F.col("taken"))
    return convs.join(heads, "base", "left").select(
        "conv", F.lit(0).alias("kind"), "own", "taken",
        F.transform(begin, lambda h: h["digest"]).alias("digests"), F.transform(begin, lambda h: h["chars"]).alias("sizes"),
    )


def _rows(turns: DataFrame, headers: DataFrame) -> DataFrame:
    """Each conversation's header and then its turns in order, dealt out by ranges and stored.

    Range bounds are sampled, and the two passes must see the same partitions.
    """
    from leafmill.session import shared_dir

    mixed = headers.unionByName(turns.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    keys = ["conv", "kind", *_ORDER]
    shared_dir(turns.sparkSession)
    return (
        mixed.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .select("conv", "own", "taken", "digests", "sizes", "digest", "chars", F.spark_partition_id().alias("chunk"))
        .checkpoint()
    )


class _Walk:
    """The state inside a conversation: turns seen and skipped, depth, key, the last keys above."""

    def __init__(self):
        self.conv: int | None = None
        self.depth = self.seen = self.taken = self.length = 0
        self.key = 0
        self.above: deque[bytes] = deque(maxlen=BAND)

    def begin(self, conv: int, own: int, taken: int, begun: int) -> None:
        self.conv, self.taken, self.length = conv, taken, begun + max(0, own - taken)
        self.depth = self.seen = self.key = 0
        self.above.clear()

    def step(self, symbol: int) -> None:
        self.above.append(self.name())
        self.key, self.depth = (self.key * _BASE + symbol) % _PRIME, self.depth + 1

    def name(self) -> bytes:
        return self.key.to_bytes(16, "big")

    def path(self) -> bytes:
        """The keys above: of this band down to the parent, or of the whole band above a root."""
        n = self.depth % BAND or min(BAND, self.depth)
        return b"".join(list(self.above)[len(self.above) - n :])

    def copy(self) -> tuple:
        return self.conv, self.depth, self.seen, self.taken, self.length, self.key, list(self.above)

    def restore(self, state: tuple) -> None:
        self.conv, self.depth, self.seen, self.taken, self.length, self.key, above = state
        self.above = deque(above, maxlen=BAND)


def _records(batches: Batches) -> Iterator[tuple]:
    for rows in batches:
        yield from zip(*(rows.column(c).to_pylist() for c in ("conv", "own", "taken", "digests", "sizes", "digest", "chars", "chunk")))


def _summaries(batches: Batches, most: int):
    """Per partition: what its first stretch does to a state that reaches it, and its last state.

    The stretch is given by its first symbols (which may be skipped) and then by maps: after n
    symbols more, a key k has become k * base^n + value; the last of them, for the keys above.
    """
    first: list[int] = []
    tail: deque[tuple[int, int]] = deque(maxlen=BAND + 1)
    conv, count, value, chunk, walk = None, 0, 0, None, _Walk()
    for c, own, taken, digests, _, digest, _, chunk in _records(batches):
        if digests is not None:
            walk.begin(c, own, taken, len(digests))
            for d in digests:
                walk.step(_symbol(d))
        elif walk.conv == c:
            walk.seen += 1
            if walk.seen > walk.taken:
                walk.step(_symbol(digest))
        else:  # the first stretch: its conversation began in an earlier partition
            conv = c
            if len(first) < most:
                first.append(_symbol(digest))
            else:
                count, value = count + 1, (value * _BASE + _symbol(digest)) % _PRIME
                tail.append((count, value))
    if chunk is not None:
        as_bytes = lambda n: n.to_bytes(16, "big")
        state = walk.copy()
        yield batch(
            {
                "chunk": [chunk], "conv": [conv], "first": [list(map(as_bytes, first))], "counts": [[n for n, _ in tail]], "values": [[as_bytes(v) for _, v in tail]],
                "last": [state[0]], "state": [None if state[0] is None else list(state[1:5])], "key": [as_bytes(state[5])], "above": [state[6]],
            },
            {
                "chunk": pa.int32(), "conv": pa.int64(), "first": pa.list_(pa.binary()), "counts": pa.list_(pa.int64()), "values": pa.list_(pa.binary()),
                "last": pa.int64(), "state": pa.list_(pa.int64()), "key": pa.binary(), "above": pa.list_(pa.binary()),
            },
        )


_SUMMARY = (
    "chunk int, conv long, first array<binary>, counts array<long>, values array<binary>, last long, state array<long>, key binary, above array<binary>"
)


def _entries(rows: DataFrame, most: int) -> dict[int, tuple]:
    """The state in which each partition begins that goes on with a conversation."""
    found = rows.mapInArrow(partial(_summaries, most=most), _SUMMARY).orderBy("chunk").collect()
    number = lambda b: int.from_bytes(b, "big")
    walk, out = _Walk(), {}
    for r in found:
        if r.conv is not None:
            out[r.chunk] = walk.copy()
            for s in map(number, r.first):
                walk.seen += 1
                if walk.seen > walk.taken:
                    walk.step(s)
            start, depth = walk.key, walk.depth
            for n, v in zip(r.counts, map(number, r.values), strict=True):
                walk.above.append(walk.name())
                walk.key, walk.depth = (start * pow(_BASE, n, _PRIME) + v) % _PRIME, depth + n
            walk.seen += r.counts[-1] if r.counts else 0
        if r["last"] is not None:
            walk.restore((r["last"], *r.state, number(r.key), r.above))
    return out


_PREFIX = {"conv": pa.int64(), "depth": pa.int64(), "key": pa.binary(), "above": pa.binary(), "chars": pa.int64(), "ended": pa.int64()}


def _prefixes(batches: Batches, entries: dict[int, tuple]):
    """A row for every prefix of every rebuilt conversation, the empty one included."""
    walk, fresh, out = _Walk(), True, []

    def row(chars: int) -> None:
        out.append((walk.conv, walk.depth, walk.name(), walk.path(), chars, int(walk.depth == walk.length)))

    for c, own, taken, digests, sizes, digest, chars, chunk in _records(batches):
        if digests is not None:
            walk.begin(c, own, taken, len(digests))
            row(0)
            for d, n in zip(digests, sizes, strict=True):
                walk.step(_symbol(d))
                row(n)
        else:
            if fresh:
                walk.restore(entries[chunk])
            walk.seen += 1
            if walk.seen > walk.taken:
                walk.step(_symbol(digest))
                row(chars)
        fresh = False
        if len(out) >= 10_000:
            yield batch(dict(zip(_PREFIX, zip(*out))), _PREFIX)
            out = []
    if out:
        yield batch(dict(zip(_PREFIX, zip(*out))), _PREFIX)


def prefixes(
    table: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    base: Column | None = None,
    taken: Column | None = None,
    most: int = 5,
) -> DataFrame:
    """(conv, depth, key, above, chars, ended) for every prefix of every conversation.

    ``base`` and ``taken`` are expressions over ``conv``: a conversation's first ``taken`` turns (at
    most ``most``) are replaced by those of the conversation ``base`` (by as many as that has).
    """
    turns = _turns(table, conv, turn, role, text)
    headers = _headers(turns, F.col("conv") if base is None else base, F.lit(0) if taken is None else taken, most)
    rows = _rows(turns, headers)
    entries = rows.sparkSession.sparkContext.broadcast(_entries(rows, most))  # one state a partition
    return rows.mapInArrow(
        lambda batches: _prefixes(batches, entries.value), "conv long, depth long, key binary, above binary, chars long, ended long"
    )


def _ends(members: DataFrame) -> DataFrame:
    """(depth, key, sha): the digest of the sorted ids of the conversations that end at a node.

    Ids are sorted by ranges, so a node's ids may lie in many partitions, each of which spells its
    own; a node that lies in one partition is done there. The others' texts are put together in
    order as a stream, since a digest has to read them so: one row for each partition.
    """
    keys = ["depth", "key", "conv"]
    rows = members.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("chunk", F.spark_partition_id())
    types = {"depth": pa.int64(), "key": pa.binary(), "chunk": pa.int32(), "text": pa.string(), "sha": pa.string()}

    def spell(batches: Batches):
        node, ids, out, edge, chunk = None, [], [], True, None

        def close(open_: bool) -> None:
            text = ",".join(ids)
            sha = None if open_ else hashlib.sha256(text.encode()).hexdigest()
            out.append((*node, chunk, text if open_ else None, sha))

        for part in batches:
            columns = (part.column(c).to_pylist() for c in (*keys, "chunk"))
            for depth, key, conv, chunk in zip(*columns):
                if node != (depth, key):
                    if node is not None:
                        close(edge)
                        edge = False
                    node, ids = (depth, key), []
                ids.append(str(conv))
            if len(out) >= 10_000:
                yield batch(dict(zip(types, zip(*out))), types)
                out.clear()
        if node is not None:
            close(True)
            yield batch(dict(zip(types, zip(*out))), types)

    def finish(batches: Batches):
        node, digest, out = None, None, []
        named = {n: types[n] for n in ("depth", "key", "sha")}
        for part in batches:
            for depth, key, text in zip(*(part.column(c).to_pylist() for c in ("depth", "key", "text"))):
                if node == (depth, key):
                    digest.update(b"," + text.encode())
                else:
                    if node is not None:
                        out.append((*node, digest.hexdigest()))
                    node, digest = (depth, key), hashlib.sha256(text.encode())
        if node is not None:
            out.append((*node, digest.hexdigest()))
        if out:
            yield batch(dict(zip(named, zip(*out))), named)

    spelled = shared_table(rows.mapInArrow(spell, "depth long, key binary, chunk int, text string, sha string"), "ends")
    open_ = spelled.where("sha is null").select("depth", "key", "chunk", "text")
    closed = open_.repartition("depth", "key").sortWithinPartitions("depth", "key", "chunk").mapInArrow(finish, "depth long, key binary, sha string")
    return spelled.where("sha is not null").select("depth", "key", "sha").unionByName(closed)


def trie(prefixed: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``prefixes``: conv_id (its smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``n_leaves`` counts the childless nodes of the subtree, ``saved_tokens`` sums (n_convs - 1) times
    the characters of a node's last text over it; ``ends_sha256`` is the digest of the ids of the
    conversations that end there. Rows of one turn come in the order of role, then of the text's
    first 32 characters, then of its digest; repeated rows are turns of their own. Null roles and
    texts are empty; rows with a null conversation id take no part. An empty table has no nodes.
    """
    prefixed = shared_table(prefixed, "prefixes")
    nodes = shared_table(
        prefixed.groupBy("depth", "key").agg(
            F.min("conv").alias("conv"), F.count("*").alias("n"), F.sum("ended").alias("ended"), F.max("chars").alias("chars"), F.max("above").alias("above")
        ),
        "nodes",
    )
    band = F.col("depth") % BAND
    own = nodes.select(
        "depth", "key", "above", (F.col("n") == F.col("ended")).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("chars")).alias("saved")
    )
    above = F.when(band == 0, F.expr("X''")).otherwise(F.col("above"))
    steps = (F.length(above) / 16).cast("int")
    inner = own.select(
        "leaves", "saved", "depth", F.explode(F.sequence(F.lit(0), steps)).alias("up"), F.concat(above, F.col("key")).alias("path")
    )
    place = F.length("path") - 16 * (F.col("up") + 1)
    # A node's direct parent counts it as a child; a band root is its parent's child too, in the band above.
    within = inner.select(
        (F.col("depth") - F.col("up")).alias("depth"), F.substring(F.col("path"), place + 1, F.lit(16)).alias("key"), "leaves", "saved",
        (F.col("up") == 1).cast("long").alias("children"),
    )
    roots = own.where((band == 0) & (F.col("depth") > 0)).select("depth", "key", "above")
    totals = shared_table(_sum(within), "bands")
    across = shared_table(roots.join(totals.select("depth", "key", "leaves", "saved"), ["depth", "key"]), "roots")
    if not across.isEmpty():
        totals = _sum(totals.unionByName(_above(_completed(across))))
    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent"), F.col("conv").alias("parent_conv"))
    ends = _ends(prefixed.where("ended = 1"))
    nothing = F.sha2(F.lit(""), 256)
    known = (
        nodes.select("depth", "key", "conv", "n", F.substring("above", -16, 16).alias("parent"))
        .join(totals, ["depth", "key"]).join(ends, ["depth", "key"], "left")
    )
    return known.join(parent, ["depth", "parent"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", nothing).alias("ends_sha256"),
    )


def _sum(rows: DataFrame) -> DataFrame:
    return rows.groupBy("depth", "key").agg(*[F.sum(c).alias(c) for c in ("leaves", "saved", "children")])


def _completed(roots: DataFrame) -> DataFrame:
    """Band roots with the totals of all bands below them, by doubling.

    After r rounds a root has the totals of the roots at most 2^r - 1 bands below it, and knows
    its ancestor 2^r bands above. ``roots``: depth, key, above, leaves, saved.
    """
    step = BAND
    state = roots.withColumn("far", F.substring("above", 1, 16))
    deepest = roots.agg(F.max("depth")).first()[0]
    while step < deepest:
        given = state.where(F.col("depth") > step).groupBy((F.col("depth") - step).alias("depth"), F.col("far").alias("key")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        )
        further = state.select((F.col("depth") + step).alias("depth"), F.col("key").alias("far"), F.col("far").alias("next"))
        state = shared_table(
            state.join(given, ["depth", "key"], "left").join(further, ["depth", "far"], "left").select(
                "depth", "key", "above", F.col("next").alias("far"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
            ),
            "roots",
        )
        step *= 2
    return state


def _above(roots: DataFrame) -> DataFrame:
    """What completed roots give to each ancestor in the band above them."""
    up = F.explode(F.sequence(F.lit(1), F.lit(BAND))).alias("up")
    given = roots.select("depth", "above", "leaves", "saved", up)
    return given.select(
        (F.col("depth") - F.col("up")).alias("depth"), F.substring(F.col("above"), 16 * (BAND - F.col("up")) + 1, F.lit(16)).alias("key"),
        "leaves", "saved", (F.col("up") == 1).cast("long").alias("children"),
    )
