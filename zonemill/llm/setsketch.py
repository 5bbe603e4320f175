"""Near-duplicate classes by SetSketch registers, banding, likelihood and verification.

A document is its set of distinct word shingles.  Each shingle hash starts a
Poisson process whose points fall on random registers; a register keeps its
first arrival x, truncated on an exponential scale to floor(1 - log_b x).
Registers of a union are the larger of both, and two registers are equal about
as often as the sets overlap.

1. rows with equal sets become one node, so copies are never compared;
2. four registers make a band; nodes that share a band value share a bucket;
3. every member of a bucket is paired with the bucket's smallest node;
4. pairs whose joint maximum-likelihood similarity is too low for chance are
   dropped, the others verified on full sets; links give components; the number
   of bands and this limit follow from the similarity of a link (``limits``);
5. a bucket that still spans several components is searched within: its strays
   (members outside its largest component) meet all members, part by part, and
   only links between components leave the task.

A bucket whose members are one component needs no more pairs, no pairs of a
group are ever written, and no link that could change a component is left out but
with the probability ``LOSS`` twice.  A bucket of n unlinked members costs n / 1024
copies of each member's set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_of, cut, drop_state, in_bitmap, spread, worker_state
from .tokens import runs

#: Registers, base of their scale, registers in a band.
M, BASE, ROWS = 128, 1.02, 4
_OFFSET = 4096
#: Most probability with which the bands, and with which the likelihood estimate, may miss a pair that just links.
LOSS = 1e-6
#: Members, and bytes of their sets, in one part of a bucket; a task holds two parts.
PART_ROWS, PART_BYTES = 1024, 32_000_000
#: Nodes of edges that a task unites before it hands them on.
MOST_NODES = 1_000_000

#: Hashes of words that a worker keeps.
MOST_WORDS = 250_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_U = np.uint64


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def _hashes(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = worker_state("word hashes", dict)
    if len(known) > MOST_WORDS:
        known.clear()
    ids = list(map(known.get, words))
    if None in ids:
        for k, i in enumerate(ids):
            if i is None:
                word = words[k]
                i = known.get(word)
                if i is None:
                    i = xxhash.xxh3_64_intdigest(word)
                    if len(word) < 100:
                        known[word] = i
                ids[k] = i
    return np.array(ids, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; all words as one if there are fewer; empty without words."""
    words = words_of(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = _hashes(words)
    n = len(h) - width + 1
    if n < 1:
        out = np.array([len(h)], dtype=np.uint64)
        for k in range(len(h)):
            out = _mix(out * _U(0x9E3779B97F4A7C15) + h[k])
        return out
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (len(sets), M) as uint16; a set without elements has zeros."""
    count = len(sets)
    first = np.full(count * M, np.inf)
    seed = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    doc = np.repeat(np.arange(count), [len(s) for s in sets])
    x = np.zeros(len(seed))
    step = 0
    while len(seed):
        step += 1
        draw = _mix(seed + _U((step * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        x = x - np.log1p(-(draw >> _U(11)).astype(np.float64) * 2.0**-53) / M
        np.minimum.at(first, doc * M + (draw & _U(M - 1)).astype(np.int64), x)
        if step <= 8 or step % 8 == 0:
            live = x < first.reshape(count, M).max(axis=1)[doc]
            if not live.all():
                seed, doc, x = seed[live], doc[live], x[live]
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(first) / math.log(BASE)) + _OFFSET
    return np.where(np.isfinite(first), np.clip(k, 1, 65535), 0).astype("<u2").reshape(count, M)


def _steps(x: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """p_b(x) = -log_b(1 - x (b - 1) / b) and its derivative."""
    z = 1 - x * (BASE - 1) / BASE
    return -np.log(z) / math.log(BASE), (BASE - 1) / (BASE * z * math.log(BASE))


def _not_below(above: np.ndarray, below: np.ndarray, u: np.ndarray | float, least: float) -> np.ndarray:
    """True where registers so often larger and smaller estimate a similarity of ``least`` or more; ``u`` is the first set's share of both sizes.

    With u, v the shares of both sizes, P(K_a > K_b) = p_b(u - v J) and
    P(K_a < K_b) = p_b(v - u J); the log-likelihood of the counts is concave in
    J, so the estimate is at least ``least`` where its slope there is not negative.
    """
    equal = M - above - below
    v = 1 - u
    p, dp = _steps(np.maximum(u - v * least, 1e-9))
    q, dq = _steps(np.maximum(v - u * least, 1e-9))
    rest = np.maximum(1 - p - q, 1e-9)
    return equal * (v * dp + u * dq) / rest - above * v * dp / p - below * u * dq / q >= 0


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """True where the joint maximum-likelihood similarity of sketches is ``least`` or more."""
    return _not_below((a > b).sum(axis=-1), (a < b).sum(axis=-1), n_a / (n_a + n_b), least)


def missed(percent: int, least: float) -> float:
    """Probability that the estimate of a pair of similarity ``percent`` / 100 is under ``least``, at the worst ratio of sizes; the exact trinomial sum."""
    link = percent / 100
    above, below = (x.ravel() for x in np.meshgrid(np.arange(M + 1), np.arange(M + 1)))
    above, below = above[above + below <= M], below[above + below <= M]
    log_fact = np.array([math.lgamma(k + 1) for k in range(M + 1)])
    ways = log_fact[M] - log_fact[above] - log_fact[below] - log_fact[M - above - below]
    worst = 0.0
    for ratio in np.linspace(link, 1, 21):
        u = ratio / (1 + ratio)
        p, q = (max(float(_steps(max(x, 0.0))[0]), 1e-300) for x in (u - (1 - u) * link, 1 - u - u * link))
        chance = np.exp(ways + above * math.log(p) + below * math.log(q) + (M - above - below) * math.log(1 - p - q))
        worst = max(worst, float(chance[~_not_below(above, below, u, least)].sum()))
    return worst


@cache
def limits(percent: int) -> tuple[int, float]:
    """Bands, and the similarity below which an estimate drops a pair, that miss a link at ``percent`` with probability ``LOSS`` at most each."""
    half = (1 - percent / 100) / 2
    equal = 1 - 2 * float(_steps(half)[0])
    bands = 1 if equal == 1 else math.ceil(math.log(LOSS) / math.log1p(-(equal**ROWS)))
    least = percent - 1
    while missed(percent, least / 100) > LOSS:
        least -= 1
    return bands, least / 100


def similar_sizes(n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


SIGNED = "doc_id long, n_shingles long, set_key binary, sketch binary"


def sign(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                sets = [shingles(t, width) for t in part["text"].to_pylist()]
                made = sketches(sets)
                keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([m.tobytes() for m in made], pa.binary())],
                    names=_columns(SIGNED),
                )

    return rows.mapInArrow(run, SIGNED)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of one partition as stars: each node with the smallest node it reaches here."""
    drop_state()
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    def stars() -> pa.RecordBatch:
        made = [(x, top) for x in list(parent) if (top := root(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.int64()) for k in (0, 1)], names=["u", "v"])

    for batch in batches:
        for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
                parent.setdefault(min(a, b), min(a, b))
        if len(parent) > MOST_NODES:
            yield stars()
    yield stars()


def components(edges: DataFrame, starred: bool = False) -> DataFrame:
    """(id, component) of every node of the edges (a, b) but the smallest of each component, which is the component's name.

    Edges point to the smaller node.  Each round makes stars of the edges that
    meet in a partition, first where they lie and then dealt by their larger
    node, until every node has one edge.  What is left is a forest, whose paths
    are halved until they end in the roots.  ``starred`` edges are stars of their
    partition already: the task that found them made them, as a second Python function in
    one task takes a second worker.
    """
    cur = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    while True:
        here = cur if starred else cur.mapInArrow(_contract, "u long, v long")
        cur, starred = cut(here.repartition("u").mapInArrow(_contract, "u long, v long")), False
        if cur.groupBy("u").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
            break
    while True:
        above = cur.select(F.col("u").alias("v"), F.col("v").alias("top"))
        if cur.join(above, "v", "left_semi").isEmpty():
            return cur.select(F.col("u").alias("id"), F.col("v").alias("component"))
        cur = cut(cur.join(above, "v", "left").select("u", F.coalesce("top", "v").alias("v")))


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Elements that two sorted sets, neither empty, have in common."""
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    return int((x[at] == y).sum())


def _is_link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    shared = _shared(x, y)
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, M)


def _verify(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes, likelihood and then the full sets confirm, as stars of each partition."""
    _, least = limits(percent)
    side = lambda x: members.select(F.col("id").alias(x), F.struct("n", "sketch", "set").alias(f"of_{x}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").where(F.least("of_a.n", "of_b.n") * 100 >= F.greatest("of_a.n", "of_b.n") * percent)

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            (n_a, s_a), (n_b, s_b) = ((batch[f"n_{x}"].to_numpy().astype(float), _matrix(batch[f"sketch_{x}"])) for x in "ab")
            ok = likely(s_a, s_b, n_a, n_b, least)
            for k in np.flatnonzero(ok).tolist():
                x, y = (np.frombuffer(batch[f"set_{side}"][k].as_buffer(), dtype="<u8") for side in "ab")
                ok[k] = _is_link(x, y, percent)
            yield batch.select(["a", "b"]).rename_columns(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stars in _contract(confirmed(batches)):
            yield stars.rename_columns(["a", "b"])

    flat = [F.col(f"of_{x}.{c}").alias(f"{c}_{x}") for x in "ab" for c in ("n", "sketch", "set")]
    return joined.select("a", "b", *flat).mapInArrow(run, "a long, b long")


def _links(table: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links between different components in one tile: its strays against its other members.

    Sets that just link share one of the rarest elements of each (as many as
    the union may lack, and one more), so only members that share such an element are
    compared, in the first band that both share.  Components that a link has united
    need no second link.
    """
    bands, least = limits(percent)
    band = table["band"][0].as_py()
    is_stray = table["is_stray"].to_numpy()
    stray, other = np.flatnonzero(is_stray), np.flatnonzero(~is_stray)
    if not len(stray) or not len(other):
        return []
    ids, n = (table[c].to_numpy() for c in ("id", "n"))
    label = np.unique(table["component"].to_numpy(), return_inverse=True)[1]
    sketch = _matrix(table["sketch"])
    values = np.ascontiguousarray(sketch[:, : ROWS * bands]).view("<u8")
    sets = [np.frombuffer(x, dtype="<u8") for x in table["set"].to_pylist()]
    owner = np.repeat(np.arange(len(sets)), n)
    code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    order = np.lexsort((code, count[code], owner))
    first = np.cumsum(n) - n
    rare = n - (percent * n + 99) // 100 + 1
    prefix = order[runs(first, rare)]
    code, owner = code[prefix], owner[prefix]
    to = np.cumsum(rare)
    of_other = np.flatnonzero(~is_stray[owner])
    of_other = of_other[np.argsort(code[of_other], kind="stable")]
    post_code, post = code[of_other], owner[of_other]
    found = []
    for k in stray.tolist():
        own = code[to[k] - rare[k] : to[k]]
        lo, hi = np.searchsorted(post_code, own), np.searchsorted(post_code, own, side="right")
        at = post[runs(lo, hi - lo)]
        at = at[(label[at] != label[k]) & similar_sizes(n[at], n[k], percent)]
        if not len(at):
            continue
        at = np.flatnonzero(np.bincount(at, minlength=len(ids)))
        at = at[(values[at] == values[k]).argmax(axis=1) == band]
        if not len(at):
            continue
        at = at[likely(sketch[k][None, :], sketch[at], np.full(len(at), float(n[k])), n[at].astype(float), least)]
        for j in at.tolist():
            if label[j] != label[k] and _is_link(sets[j], sets[k], percent):
                found.append((int(ids[j]), int(ids[k])))
                label[label == label[j]] = label[k]
    return found


def _search(open_rows: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links between components within buckets.

    ``open_rows``: band, key, id, component, top (the bucket's largest component),
    parts and stray_parts.  A bucket's members are dealt into ``parts`` parts and its
    strays into ``stray_parts``; a tile holds one part of each, so that a task's share is
    bounded however large a bucket is.
    """
    rows = open_rows.join(members, "id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    kept = ["band", "key", "stray_part", "part", "is_stray", "id", "n", "sketch", "set", "component"]
    others = rows.withColumns({"stray_part": every("stray_parts"), "part": one("parts"), "is_stray": F.lit(False)}).select(*kept)
    strays = rows.where("component <> top").withColumns({"stray_part": one("stray_parts"), "part": every("parts"), "is_stray": F.lit(True)}).select(*kept)

    def search(table: pa.Table) -> pa.Table:
        drop_state()
        found = _links(table, percent)
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return others.union(strays).groupBy("band", "key", "stray_part", "part").applyInArrow(search, "a long, b long")


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Two rows are linked if 100 * intersection >= ``percent`` * union of their
    shingle sets (words split at ASCII white space, A-Z lower-cased).  A row's
    component is the smallest id reachable over links, and the row with that id
    is kept.

    * texts that are null or have no words have an empty set and link with
      nothing; fewer than ``width`` words are one shingle
    * a null id takes no part: its component is null and it is kept
    * rows of one id are one node: repeated rows share their component; of
      different texts under one id the smallest set is compared
    * texts of any length are compared whole
    * an empty table gives an empty result; other columns are not read
    """
    if percent < 80:
        raise ValueError("the registers have bands enough for links of 80 percent or more")
    signed = cut(sign(docs, width, id_col, text_col))
    real = signed.where("doc_id is not null and n_shingles > 0")
    classes = cut(real.groupBy("set_key").agg(F.min(F.struct(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch")).alias("x"), F.count("*").alias("c")).select("set_key", "c", "x.*"))
    bands = limits(percent)[0]
    value = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.substring(F.col("sketch"), i * (2 * ROWS) + 1, F.lit(2 * ROWS)))
    placed = classes.select("id", "n", F.posexplode(value).alias("band", "value")).select("id", "n", "band", F.xxhash64("band", "value").alias("key"))
    shared = placed.groupBy("band", "key").agg(F.count("*").alias("c"), F.min("id").alias("lead"), F.sum("n").alias("elements")).where("c > 1")
    total = classes.count() * bands
    buckets = cut(spread(placed, shared, ["band", "key"], "c", total).drop("n"))

    # Sketches and full sets of the nodes in buckets, from their texts; the bitmap keeps other texts out of the shuffle.
    bits, size = bitmap_of(buckets.select("id").distinct(), "id")
    texts = in_bitmap(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), F.col("id"), bits, size).where("_hit").select("id", "text")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                sets = [shingles(t, width) for t in part["text"].to_pylist()]
                made = [m.tobytes() for m in sketches(sets)]
                columns = [pa.array([len(x) for x in sets], pa.int64()), pa.array(made, pa.binary()), pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([part["id"], *columns], names=["id", "n", "sketch", "set"])

    each = texts.mapInArrow(full, "id long, n long, sketch binary, set binary").where("id is not null and n > 0")
    members = cut(each.groupBy("id").agg(F.min(F.struct("n", "sketch", "set")).alias("x")).select("id", "x.*"))

    pairs = buckets.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    found = components(_verify(pairs, members, percent), starred=True)
    labelled = cut(buckets.where("c > 2").drop("lead").join(found, "id", "left").withColumn("component", F.coalesce("component", "id")))
    sized = labelled.groupBy("band", "key", "component").agg(F.count("*").alias("c"), F.max("elements").alias("elements"))
    parts = F.ceil(F.greatest(F.col("all") / PART_ROWS, F.col("elements") * 8 / PART_BYTES)).cast("int")
    stray_parts = F.ceil(parts * (F.col("all") - F.col("most")) / F.col("all")).cast("int")
    open_ = (
        sized.groupBy("band", "key")
        .agg(F.max(F.struct("c", "component"))["component"].alias("top"), F.max("c").alias("most"), F.sum("c").alias("all"), F.max("elements").alias("elements"), F.count("*").alias("several"))
        .where("several > 1")
        .select("band", "key", "top", "all", parts.alias("parts"), stray_parts.alias("stray_parts"))
    )
    more = cut(_search(spread(labelled.select("band", "key", "id", "component"), open_, ["band", "key"], "all", total), members, percent))
    if not more.isEmpty():
        found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))

    named = classes.select("set_key", "c", "id").join(found, "id", "left").select("set_key", "c", F.coalesce("component", "id").alias("component_id"))
    narrow = signed.select("doc_id", "n_shingles", "set_key")
    real = narrow.where("doc_id is not null and n_shingles > 0")
    rest = narrow.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    placed_rows = spread(real, named, ["set_key"], "c", total // bands).select("doc_id", "n_shingles", "component_id")
    return rest.unionByName(placed_rows).withColumn("kept", F.col("doc_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id")))
