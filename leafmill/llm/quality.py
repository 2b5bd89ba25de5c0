"""Quality classifier by hierarchical empirical Bayes.

A document's own evidence is a logistic regression over its shape (symbols, capitals,
repetition, ...) and over words that labelled documents show to be telling. It is combined
with what is known of its site: the share of good documents of a host is a posterior that
shrinks from the host's own mean to the global one, and a path's shrinks to its host's, the
more the fewer documents it has. The strengths of these priors are estimated from the
spread of the sites' means (method of moments). Two targets are judged alike: quality, and
toxicity; a document is kept if it is probably good and probably not toxic.

The classifier is fitted on a bounded sample of labelled documents (``sample_rows``,
chosen by a hash of the id), and knows a bounded number of telling words (``telling`` places
for each target; a word shares its place with its own stems). All else, evidence, sites and
global shares, covers all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import Batches, as_bytes, shared_table

#: Sites up to this many rows are joined by broadcast, more by a shuffled join.
SMALL_SITES = 100_000
#: Defaults: places for words of the classifier for each target, labelled documents that a
#: word must be in, and bytes of the longest words that are looked at.
TELLING, LEAST_DOCS, WORD_BYTES = 160, 8, 40

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_CAPITALS = bytes(range(65, 91))
_SMALL = bytes(range(97, 123))
_SYMBOLS = b"#$%&*+<=>@[]^_`{|}~!\\"
_TARGETS = ("quality", "toxic")
_LINE = re.compile(rb"[\n.]+")


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters, in lower case."""
    return text.translate(_LETTERS).split()


#: Lengths (bytes) of the beginnings of words that count as units beside whole words.
_STEMS = range(4, 9)


def units_of(words: list[bytes], word_bytes: int = WORD_BYTES) -> set[bytes]:
    """Whole words, and beginnings of longer ones, marked by a star."""
    distinct = {w for w in words if len(w) <= word_bytes}
    return distinct | {w[:k] + b"*" for w in distinct for k in _STEMS if len(w) > k}


def in_places(units: list[bytes], places: int) -> list[bytes]:
    """The first units, until one would need a place too many; a word and its own stems share one."""

    def stem_of(a: bytes, b: bytes) -> bool:
        return a.endswith(b"*") and len(b) >= len(a) and b.startswith(a[:-1])

    out: list[bytes] = []
    longest: list[bytes] = []  # of each place; the place's other units are stems of it
    for unit in units:
        at = next((i for i, known in enumerate(longest) if stem_of(unit, known) or stem_of(known, unit)), len(longest))
        if at == places:
            break
        if at == len(longest):
            longest.append(unit)
        elif stem_of(longest[at], unit):
            longest[at] = unit
        out.append(unit)
    return out


def shape(text: bytes, words: list[bytes]) -> list[float]:
    """Numbers, each between 0 and about 1, that describe how a text looks."""
    size = len(text) or 1
    capitals = size - len(text.translate(None, _CAPITALS))
    small = size - len(text.translate(None, _SMALL))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    pipes = text.count(b"|")
    digits = len(text) - len(text.translate(None, b"0123456789"))
    lines = [x for x in _LINE.split(text) if x.strip()]
    distinct = len(set(words))
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    n = len(words)
    return [
        min(1.0, 10 * symbols / size), float(symbols > 0.02 * size), capitals / (capitals + small + 1), min(1.0, 20 * digits / size),
        min(1.0, 20 * pipes / size), float(n < 5), float(n < 20), np.log1p(n) / 10, distinct / (n or 1), repeats / (n or 1),
        len(set(lines)) / (len(lines) or 1), min(1.0, sum(map(len, words)) / (n or 1) / 12),
        text.count(b"!") / (n or 1), min(1.0, n / (len(lines) or 1) / 40), float(n == 0),
    ]


N_SHAPE = 15
#: Rows that a fit unpacks at a time.
_FIT_ROWS = 1024


class Model:
    """Logistic regressions over shape and telling words, one for each target."""

    def __init__(self, words: list[bytes], word_bytes: int = WORD_BYTES):
        self.word_bytes = word_bytes
        self.place = {w: N_SHAPE + i for i, w in enumerate(words)}
        #: First bytes of the units; a word that begins otherwise has none.
        self.gate = {w.rstrip(b"*")[:4] for w in words}
        self.size = N_SHAPE + len(words)
        self.weights = np.zeros((len(_TARGETS), self.size + 1))
        self.mean, self.scale = np.zeros(self.size), np.ones(self.size)
        self.shares = np.full(len(_TARGETS), 0.5)

    def row(self, text: bytes) -> np.ndarray:
        words = words_of(text)
        out = np.zeros(self.size)
        out[:N_SHAPE] = shape(text, words)
        if near := [w for w in set(words) if w[:4] in self.gate]:
            for unit in units_of(near, self.word_bytes) & self.place.keys():
                out[self.place[unit]] = 1
        return out

    def row_bytes(self, text: bytes) -> bytes:
        """A row for the way to the driver: shape as floats, words as bits."""
        row = self.row(text)
        return row[:N_SHAPE].astype("<f4").tobytes() + np.packbits(row[N_SHAPE:] > 0).tobytes()

    def rows_of(self, packed: np.ndarray) -> np.ndarray:
        """Rows from what ``row_bytes`` made, a line of bytes each."""
        shapes = np.ascontiguousarray(packed[:, : 4 * N_SHAPE]).view("<f4").astype(float)
        return np.c_[shapes, np.unpackbits(packed[:, 4 * N_SHAPE :], axis=1, count=self.size - N_SHAPE)]

    def fit(self, packed: np.ndarray, targets: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> None:
        """Rows stay packed; sums are taken over a few of them at a time."""
        n = len(packed)
        parts = [slice(low, low + _FIT_ROWS) for low in range(0, n, _FIT_ROWS)]
        self.mean = sum(self.rows_of(packed[s]).sum(0) for s in parts) / n
        self.scale = np.sqrt(sum(((self.rows_of(packed[s]) - self.mean) ** 2).sum(0) for s in parts) / n) + 0.05
        penalty = np.full(self.size + 1, ridge)
        penalty[-1] = 1e-6
        self.shares = (targets.sum(0) + 1) / (n + 2)
        for t in range(targets.shape[1]):
            beta = np.zeros(self.size + 1)
            for _ in range(rounds):  # damped Newton steps
                gradient, curve = -penalty * beta, np.diag(penalty)
                for s in parts:
                    x = self.rows_of(packed[s])
                    z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
                    p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
                    gradient = gradient + z.T @ (targets[s, t] - p)
                    curve = curve + (z * (p * (1 - p) + 1e-4)[:, None]).T @ z
                step = np.linalg.solve(curve, gradient)
                beta += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
                if np.abs(step).max() < 1e-6:
                    break
            self.weights[t] = beta

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds, a column for each target."""
        return np.clip(np.c_[(x - self.mean) / self.scale, np.ones(len(x))] @ self.weights.T, -30, 30)


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents, chosen by a hash of the id."""
    clean = labels.groupBy(F.col(id_col).alias("id")).agg(*(F.max(t).cast("int").alias(t) for t in _TARGETS)).dropna()
    chosen = clean.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "id")  # `rows` narrow rows at most


def _telling(sample: DataFrame, telling: int = TELLING, least_docs: int = LEAST_DOCS, word_bytes: int = WORD_BYTES) -> list[bytes]:
    """Words whose share of documents differs most between the classes, for each target."""

    def count(batches: Batches):
        seen = [Counter(), Counter(), Counter()]  # of the sample's rows in this task
        for rows in batches:
            for text, *targets in zip(as_bytes(rows.column("text")), *(rows.column(t).to_pylist() for t in _TARGETS), strict=True):
                units = units_of(words_of(text), word_bytes)
                for counter, counts in zip(seen, (1, *targets), strict=True):
                    if counts:
                        counter.update(units)
        words = list(seen[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()), *(pa.array([c[w] for w in words], pa.int64()) for c in seen)],
            names=["word", "n", *_TARGETS],
        )

    totals = sample.agg(F.count("*"), F.sum("quality"), F.sum("toxic")).first()
    n, totals = totals[0], dict(zip(_TARGETS, totals[1:], strict=True))
    if not n:
        return []
    words = sample.mapInArrow(count, "word binary, n long, quality long, toxic long").groupBy("word").agg(
        *(F.sum(c).alias(c) for c in ("n", *_TARGETS))
    )
    chosen: list[bytes] = []
    for t in _TARGETS:
        yes, no = (totals[t] or 0) + 1.0, n - (totals[t] or 0) + 1.0
        a, b = (F.col(t) + 0.5) / yes, (F.col("n") - F.col(t) + 0.5) / no
        # The difference of log shares, in its standard errors.
        z = F.abs(F.log(a / b)) / F.sqrt(1 / (F.col(t) + 0.5) + 1 / (F.col("n") - F.col(t) + 0.5))
        most = telling * (len(_STEMS) + 1)  # as many units as fit if each place is full
        rows = words.filter(F.col("n") >= least_docs).orderBy(z.desc(), "word").limit(most).collect()
        chosen += in_places([bytes(r.word) for r in rows], telling)
    return list(dict.fromkeys(chosen))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = 12_000,
    telling: int = TELLING,
    least_docs: int = LEAST_DOCS,
    word_bytes: int = WORD_BYTES,
) -> Model:
    """The classifier, fitted on at most ``sample_rows`` labelled documents.

    Words are evidence if they are among the most telling of a target (``telling`` places, of
    a word and its stems each), in ``least_docs`` labelled documents and not above ``word_bytes``.
    """
    sample = shared_table(_labelled(docs, labels, id_col, text_col, sample_rows).repartition(8), "labelled")
    model = Model(_telling(sample, telling, least_docs, word_bytes), word_bytes)

    def features(batches: Batches):
        for rows in batches:
            x = [model.row_bytes(t) for t in as_bytes(rows.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.binary()), rows.column("quality"), rows.column("toxic")], names=["x", "quality", "toxic"]
            )

    rows = sample.mapInArrow(features, "x binary, quality int, toxic int").collect()  # sample_rows, about a hundred bytes each
    if rows:
        rows.sort(key=lambda r: (bytes(r.x), r.quality, r.toxic))
        packed = np.frombuffer(b"".join(r.x for r in rows), np.uint8).reshape(len(rows), -1)
        model.fit(packed, np.array([[r.quality, r.toxic] for r in rows], float))
    return model


def _score(batches: Batches, model):
    for rows in batches:
        texts = as_bytes(rows.column("text"))
        z = np.zeros((len(texts), len(_TARGETS)))
        for low in range(0, len(texts), 1024):  # a few megabytes of evidence at a time
            z[low : low + 1024] = model.value.score(np.array([model.value.row(t) for t in texts[low : low + 1024]]))
        yield pa.RecordBatch.from_arrays(
            [rows.column("row"), rows.column("host"), rows.column("path"), pa.array(z[:, 0]), pa.array(z[:, 1])],
            names=["row", "host", "path", "z_quality", "z_toxic"],
        )


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(means: DataFrame, target: str) -> float:
    """Documents that the prior counts for: the sites' spread beyond what chance explains."""
    mean = F.col(f"sum_{target}") / F.col("n")
    row = means.agg(
        F.sum(f"sum_{target}").alias("s"), F.sum("n").alias("n"), F.sum(F.col("n") * mean * mean).alias("ss"),
        F.sum(F.col(f"var_{target}")).alias("within"), F.count("*").alias("sites"),
    ).first()
    if not row.n or row.sites < 2:
        return 1e6
    mu = row.s / row.n
    between = row.ss / row.n - mu * mu - (row.within or 0) / row.n * (row.sites - 1) / row.n
    return float(np.clip(mu * (1 - mu) / max(between, 1e-9) - 1, 5.0, 1e6))


def sites(scored: DataFrame) -> DataFrame:
    """(host, path) with the shrunk shares of each target and what a document's own part is."""
    p = {t: 1 / (1 + F.exp(-F.col(f"z_{t}"))) for t in _TARGETS}
    paths = shared_table(
        scored.groupBy("host", "path").agg(
            F.count("*").alias("n"),
            *(F.sum(p[t]).alias(f"sum_{t}") for t in _TARGETS),
            *(F.coalesce(F.var_samp(p[t]), F.lit(0.0)).alias(f"var_{t}") for t in _TARGETS),
        ),
        "sites",
    )
    hosts = paths.groupBy("host").agg(
        F.sum("n").alias("n"), *(F.sum(f"sum_{t}").alias(f"sum_{t}") for t in _TARGETS),
        *((F.sum(F.col("n") * F.col(f"var_{t}")) / F.sum("n")).alias(f"var_{t}") for t in _TARGETS),
    )
    hosts = shared_table(hosts, "hosts")
    total = hosts.agg(F.sum("n").alias("n"), *(F.sum(f"sum_{t}").alias(t) for t in _TARGETS)).first()
    out = paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host")))
    columns = [F.col("p.host").alias("site_host"), F.col("p.path").alias("site_path"), F.col("p.n").alias("n")]
    for t in _TARGETS:
        mu = min(max(total[t] / total.n, 1e-4), 1 - 1e-4) if total.n else 0.5
        host_strength, path_strength = _strength(hosts, t), _strength(paths, t)
        host_share = (host_strength * mu + F.col(f"h.sum_{t}")) / (host_strength + F.col("h.n"))
        columns += [
            host_share.alias(f"host_{t}"), F.col(f"p.sum_{t}").alias(f"sum_{t}"), F.lit(path_strength).alias(f"strength_{t}"),
        ]
    return out.select(*columns)


def judge(
    docs: DataFrame,
    labels: DataFrame,
    carry: Sequence[str] = ("doc_id",),
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    sample_rows: int = 12_000,
    telling: int = TELLING,
    least_docs: int = LEAST_DOCS,
    word_bytes: int = WORD_BYTES,
) -> DataFrame:
    """Every document's verdict: ``row`` (struct of ``carry``), p_quality, p_toxic, kept.

    Host and path are any columns that name a site and a part of it (``documents`` has no
    URLs, so by default its source and lang stand in for them); null is a site of its
    own. ``sample_rows``, ``telling``, ``least_docs`` and ``word_bytes`` bound what the
    classifier learns from, as ``fit`` says. Null and empty texts have the evidence of a text without words. Repeated rows are
    judged alike, and count each. Labels may be missing (then every document has even
    evidence and is kept), repeated (the larger value counts) or null (left out). An empty
    table gives no rows; carried columns may have any names.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels, id_col, text_col, sample_rows, telling, least_docs, word_bytes))
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col(text_col).cast("string").alias("text"),
        F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"),
    )
    kind = rows.schema["row"].dataType.simpleString()
    scored = shared_table(
        rows.mapInArrow(partial(_score, model=model), f"row {kind}, host string, path string, z_quality double, z_toxic double"),
        "evidence",
    )
    site = shared_table(sites(scored), "priors")
    if site.count() <= SMALL_SITES:
        site = F.broadcast(site)
    same = F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path"))
    joined = scored.join(site, same, "left")
    shares = dict(zip(_TARGETS, model.value.shares.tolist(), strict=True))
    out = {}
    for t in _TARGETS:
        own = 1 / (1 + F.exp(-F.col(f"z_{t}")))
        # The site without the document itself, so that its evidence counts once.
        prior = (F.col(f"strength_{t}") * F.col(f"host_{t}") + F.col(f"sum_{t}") - own) / (F.col(f"strength_{t}") + F.col("n") - 1)
        prior = F.least(F.greatest(prior, F.lit(0.02)), F.lit(0.98))
        odds = F.col(f"z_{t}") + _logit(prior) - float(np.log(shares[t] / (1 - shares[t])))
        out[t] = 1 / (1 + F.exp(-odds))
    known = bool(np.any(model.value.weights))
    kept = (F.col("p_quality") >= 0.5) & (F.col("p_toxic") < 0.5) if known else F.lit(True)
    return joined.select("row", *(out[t].alias(f"p_{t}") for t in _TARGETS)).withColumn("kept", kept)
