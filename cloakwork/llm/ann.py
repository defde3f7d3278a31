"""Approximate nearest neighbours by inner product: NN-descent graph, greedy graph search.

Nodes are put into bands by length: the longest and those down to a quarter of it, those down to a
quarter of that, and so on; each band has a neighbour graph.  Inside a band vectors are divided by the
band's upper end and get one more component that makes their lengths equal, so the largest inner product is
also the nearest neighbour, and no long vector of another band decides what is near.  Equal vectors
are one node; their smallest ids come back at the end.

Build: random hyperplanes put nodes into small blocks, several times over, whose best pairs start the
graph; nodes of nearly empty blocks share blocks.  Then NN-descent: each node introduces its neighbours
(and a sample of the nodes that name it) to each other, and everybody keeps the ``DEGREE`` best met so
far, as joins and shuffles of node ids with their vectors, until a round changes less than ``DELTA`` of all edges.

Search: in every band a query starts at ``ENTRIES`` of its longest vectors and as many taken by a hash, in its own
band also at its node, and, round by round, opens all nodes among its ``BEAM`` best of the band that
are not open yet, until there are none.  All queries and bands go together; the best of all bands are the result.

All rows are indexed, whatever their number.  The graph is approximate; scores are exact inner products
in double precision on the original vectors.

Cases: vectors that are null, zero, or hold null or non-finite components, vectors of another length
than most, and null ids take no part; rows with the same id and vector are one; of rows with the same
id and different vectors each is a candidate; ties go to the smaller id; an empty table gives an
empty result; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakwork.llm.common import written
from cloakwork.llm.jaccard_join import _by_group

DEGREE, FRIENDS, FANS, PROPOSALS, DELTA = 32, 24, 14, 16, 0.05
TREES, BLOCK, FEW, BEAM, ENTRIES = 6, 320, 16, 96, 32
BAND = 2.0  # binary logarithm of the ratio of lengths in a band
_EDGES = "u long, vs array<long>, ss array<float>"


def _valid(dtype: str, k: int):
    def run(batches):
        for batch in batches:
            groups: dict[bytes, list[int]] = {}
            for i, v in zip(batch.column("id").to_pylist(), batch.column("vec"), strict=True):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(dtype)
                if np.isfinite(x).all() and x.any():
                    groups.setdefault((x + 0).tobytes(), []).append(i)
            ids = [sorted(set(x))[:k] for x in groups.values()]
            yield pa.record_batch([pa.array(list(groups), pa.binary()), pa.array(ids, pa.list_(pa.int64()))], ["vec", "ids"])

    return run


def nodes(table: DataFrame, id_col: str, vec_col: str, k: int) -> tuple[DataFrame, str]:
    """Distinct vectors as bytes, each with its ``k`` smallest ids; ``rep`` is the smallest.  And their number type."""
    kind = table.schema[vec_col].dataType.elementType
    dtype = "float32" if isinstance(kind, T.FloatType) else "float64"
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).mapInArrow(_valid(dtype, k), "vec binary, ids array<long>")
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k).alias("ids")
    salted = rows.groupBy("vec", (F.element_at("ids", 1) % 64).alias("salt")).agg(least)
    found = written(salted.groupBy("vec").agg(least).withColumn("rep", F.element_at("ids", 1)), "vectors")
    usual = found.groupBy(F.octet_length("vec").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    # rows of one id with different vectors: nodes need names of their own
    named = found.filter(F.octet_length("vec") == (usual["n"] if usual else 0)).withColumn(
        "u", F.when(F.size("ids") > 0, F.xxhash64("vec")))
    return named, dtype


def _matrix(column, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _longer(x: np.ndarray) -> np.ndarray:
    """Vectors of length one at most, with the component that brings all to length one."""
    x = x.astype(np.float32)
    rest = np.sqrt(np.maximum(1 - (x.astype(np.float64) ** 2).sum(axis=1), 0))
    return np.hstack([x, rest[:, None].astype(np.float32)])


def _lengths(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and binary logarithms of lengths, without overflow."""
    peak = np.abs(x).max(axis=1)
    x = x / peak[:, None]
    length = np.sqrt((x ** 2).sum(axis=1))
    return x / length[:, None], np.log2(peak) + np.log2(length)


def _planes(bits: dict[int, int]):
    """Blocks of nodes by the side of random planes they lie on; ``bits`` planes in each band."""
    most = max(bits.values(), default=0)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _longer(_matrix(batch.column("vec"), "float16"))
            mask = (1 << np.array([bits[b] for b in batch.column("band").to_pylist()], np.int64)) - 1
            for t in range(TREES):
                plane = np.random.default_rng(100 + t).standard_normal((x.shape[1], max(1, most))).astype(np.float32)
                code = ((x @ plane > 0) @ (1 << np.arange(max(1, most)))).astype(np.int64) & mask
                yield pa.record_batch([pa.array(np.full(len(x), t, np.int32)), batch.column("band"), pa.array(code), batch.column("u"), batch.column("vec")],
                                      ["tree", "band", "code", "u", "vec"])

    return run


def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> pa.RecordBatch:
    """Per row its k most similar others."""
    np.fill_diagonal(sims, -np.inf)
    k = min(k, len(ids) - 1)
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k else np.zeros((len(ids), 0), int)
    cuts = pa.array((np.arange(len(ids) + 1) * k).astype(np.int32))
    return pa.record_batch([pa.array(ids), pa.ListArray.from_arrays(cuts, pa.array(ids[at].ravel())),
                            pa.ListArray.from_arrays(cuts, pa.array(np.take_along_axis(sims, at, 1).ravel().astype(np.float32)))], ["u", "vs", "ss"])


def _meet(names: list[str], k: int):
    """Everybody in a group meets everybody else there and keeps the k most similar."""
    def run(batches):
        held, n = [], 0
        for group in _by_group(batches, names):
            if group.num_rows > 1:
                x = _longer(_matrix(group["vec"], "float16"))
                held.append(_best(group["u"].to_numpy(), x @ x.T, k))
                n += group.num_rows
            if n > 20_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def _whole_groups(batches):
    """Tables that end where a value of ``u`` ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        u = batch.column("u").to_numpy()
        cut = int(np.flatnonzero(u != u[-1])[-1]) + 1 if len(u) and u[0] != u[-1] else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif len(u):
            if held and held[-1].column("u")[-1].as_py() != u[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _kept(k: int):
    """Per node the k most similar of all it has met."""
    def run(batches):
        for table in _whole_groups(batches):
            table = table.combine_chunks()
            lists = table["vs"].combine_chunks()
            n = np.diff(lists.offsets.to_numpy())
            u, v, s = np.repeat(table["u"].to_numpy(), n), lists.flatten().to_numpy(), table["ss"].combine_chunks().flatten().to_numpy()
            order = np.lexsort((v, u))
            u, v, s = u[order], v[order], s[order]
            new = np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]))[:len(u)]
            u, v, s = u[new], v[new], s[new]
            order = np.lexsort((v, -s, u))
            u, v, s = u[order], v[order], s[order]
            start = np.flatnonzero(np.append(True, u[1:] != u[:-1])[:len(u)])
            rank = np.arange(len(u)) - np.repeat(start, np.diff(np.append(start, len(u))))
            u, v, s = u[rank < k], v[rank < k], s[rank < k]
            start = np.flatnonzero(np.append(True, u[1:] != u[:-1])[:len(u)])
            cuts = pa.array(np.append(start, len(u)).astype(np.int32))
            yield pa.record_batch([pa.array(u[start]), pa.ListArray.from_arrays(cuts, pa.array(v)), pa.ListArray.from_arrays(cuts, pa.array(s))], ["u", "vs", "ss"])

    return run


def _merged(edges: DataFrame, k: int) -> DataFrame:
    return written(edges.repartition("u").sortWithinPartitions("u").mapInArrow(_kept(k), _EDGES), "graph")


def _blocks(rows: DataFrame) -> DataFrame:
    """The rows with ``part``: blocks of at most about ``BLOCK`` nodes; those of cells with few nodes share cell -1 of their band."""
    cell = ["tree", "band", "code"]
    sizes = rows.groupBy(*cell).agg(F.count("*").alias("m")).withColumn("into", F.when(F.col("m") < FEW, -1).otherwise(F.col("code")))
    whole = sizes.groupBy("tree", "band", "into").agg(F.sum("m").alias("m"))
    placed = rows.join(sizes.drop("m").join(whole, ["tree", "band", "into"]), cell)
    return placed.select("tree", "band", F.col("into").alias("code"), F.pmod(F.xxhash64("u", "tree"), F.ceil(F.col("m") / BLOCK)).cast("int").alias("part"), "u", "vec")


def neighbour_graph(vectors: DataFrame, sizes: dict[int, int], degree: int = DEGREE, delta: float = DELTA) -> DataFrame:
    """NN-descent: u, vs (its most similar nodes of its band, best first), ss."""
    bits = {band: max(0, round(np.log2(max(1, n) / (BLOCK * 0.7)))) for band, n in sizes.items()}
    rows = written(vectors.mapInArrow(_planes(bits), "tree int, band int, code long, u long, vec binary"), "planes")
    block = ["tree", "band", "code", "part"]
    graph = _merged(_blocks(rows).repartition(*block).sortWithinPartitions(*block).mapInArrow(_meet(block, degree), _EDGES), degree)
    while True:
        friends = graph.select(F.col("u").alias("w"), F.explode(F.slice("vs", 1, FRIENDS)).alias("v"))
        # a node named by many others meets a sample of them: whom it misses it can meet through others
        fans = graph.select(F.explode(F.slice("vs", 1, FRIENDS)).alias("w"), F.col("u").alias("v"))
        named = graph.select(F.explode(F.slice("vs", 1, FRIENDS)).alias("w")).groupBy("w").agg(F.count("*").alias("m"))
        some = fans.join(named, "w").filter(F.pmod(F.xxhash64("w", "v"), F.col("m")) < FANS).select("w", "v")
        guests = friends.union(some).union(graph.select(F.col("u").alias("w"), F.col("u").alias("v"))).distinct()
        invited = guests.join(vectors.select(F.col("u").alias("v"), "vec"), "v").select("w", F.col("v").alias("u"), "vec")
        met = invited.repartition("w").sortWithinPartitions("w").mapInArrow(_meet(["w"], PROPOSALS), _EDGES)
        before, graph = graph, _merged(graph.union(met), degree)
        new = F.size(F.array_except("vs", F.coalesce("old", F.array().cast("array<long>"))))
        changed = graph.join(before.select("u", F.col("vs").alias("old")), "u", "left").agg(
            F.coalesce(F.sum(new) / F.sum(F.size("vs")), F.lit(0.0)).alias("share")).first()["share"]
        if changed < delta:
            return graph


def _step(dtype: str, beam: int):
    """Adds the vectors a query has reached to its list; opens what is new among its best."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.select(["q", "band", "qvec", "vs", "ss", "seen", "next"])
        row = left.slice(0, 1).to_pylist()[0]
        q = np.frombuffer(row["qvec"], dtype).astype(np.float64)
        v, s, seen = np.array(row["vs"], np.int64), np.array(row["ss"], np.float64), set(row["seen"])
        if right.num_rows:
            new, first = np.unique(right["v"].to_numpy(), return_index=True)
            take = ~np.isin(new, v)
            x = _matrix(right["vec"].take(pa.array(first[take])), dtype).astype(np.float64) if take.any() else np.zeros((0, len(q)))
            v, s = np.concatenate((v, new[take])), np.concatenate((s, x @ q))
        order = np.lexsort((v, -s))[:beam]
        v, s = v[order], s[order]
        fresh = [i for i in v.tolist() if i not in seen]
        return pa.table({"q": pa.array([row["q"]], pa.int64()), "band": pa.array([row["band"]], pa.int32()), "qvec": pa.array([row["qvec"]], pa.binary()), "vs": pa.array([v.tolist()], pa.list_(pa.int64())),
                         "ss": pa.array([s.tolist()], pa.list_(pa.float64())), "seen": pa.array([[*seen, *fresh]], pa.list_(pa.int64())),
                         "next": pa.array([fresh], pa.list_(pa.int64()))})

    return run


def search(queries: DataFrame, vectors: DataFrame, graph: DataFrame, dtype: str, entries: list[tuple[int, int]], beam: int = BEAM) -> DataFrame:
    """q, vs, ss: the best nodes found for each query vector (columns q: its node, home: its band, qvec), one row a band.

    ``entries`` (band, node) are met by all queries at the start.
    """
    bands = F.array(*[F.lit(b) for b in sorted({b for b, _ in entries})]).cast("array<int>")
    none = F.array().cast("array<long>")
    schema = "q long, band int, qvec binary, vs array<long>, ss array<double>, seen array<long>, next array<long>"
    state = queries.select("q", "home", "qvec", F.explode(bands).alias("band")).select(
        "q", "band", "qvec", none.alias("vs"), F.array().cast("array<double>").alias("ss"), none.alias("seen"), F.when(F.col("band") == F.col("home"), F.array("q")).otherwise(none).alias("next"))
    # at most twice ENTRIES rows for each band, and bands are few
    start = state.select("q", "band").join(F.broadcast(queries.sparkSession.createDataFrame(entries, "band int, v long")), "band").select("q", "band", "v")
    reach = graph.select("u", F.concat(F.array("u"), "vs").alias("vs"))
    while True:
        front = state.select("q", "band", F.explode("next").alias("u"))
        reached = front.join(reach, "u", "left").select("q", "band", F.explode(F.coalesce("vs", F.array("u"))).alias("v"))
        reached = (reached if start is None else reached.union(start)).distinct()
        start = None
        met = reached.join(vectors.select(F.col("u").alias("v"), "vec"), "v").select(F.col("q").alias("of"), F.col("band").alias("within"), "v", "vec")
        state = written(state.groupBy("q", "band").cogroup(met.groupBy("of", "within")).applyInArrow(_step(dtype, beam), schema), "search")
        if state.filter(F.size("next") > 0).isEmpty():
            return state.select("q", "vs", "ss")


def nearest(table: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            degree: int = DEGREE, delta: float = DELTA, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``."""
    known, dtype = nodes(table, id_col, vec_col, k + 1)
    measured = written(known.select("u", "vec", "ids").mapInArrow(_measured(dtype), "u long, vec binary, ids array<long>, length double"), "nodes")
    longest = measured.agg(F.max("length").alias("m")).first()["m"]
    vectors = measured.withColumn("band", F.floor((F.lit(longest) - F.col("length")) / BAND).cast("int"))
    # bands are few, however long the table: exponents of numbers are bounded
    sizes = {r["band"]: r["n"] for r in vectors.groupBy("band").agg(F.count("*").alias("n")).collect()}
    rank = lambda *by: F.row_number().over(Window.partitionBy("band").orderBy(*by))
    doors = [vectors.select("band", "u", rank(*by).alias("no")).filter(F.col("no") <= ENTRIES) for by in ((F.desc("length"), F.col("u")), (F.xxhash64("u"), F.col("u")))]
    entries = [(r["band"], r["u"]) for r in doors[0].union(doors[1]).select("band", "u").distinct().collect()]
    # the graph is built on half-precision vectors of length one at most, scores come from the originals
    halves = written(vectors.select("u", "band", "vec", (F.lit(longest) - BAND * F.col("band")).alias("top")).mapInArrow(_halves(dtype), "u long, band int, vec binary"), "halves")
    graph = neighbour_graph(halves, sizes, degree, delta)
    asked = table.filter(F.col(id_col) % every == 0).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).mapInArrow(
        _valid(dtype, 1 << 62), "vec binary, ids array<long>").select("vec", F.explode("ids").alias("query_id")).distinct()
    of = written(asked.join(vectors.select("u", "band", "vec"), "vec").select("query_id", F.col("u").alias("q"), F.col("band").alias("home"), F.col("vec").alias("qvec")), "queries")
    found = search(of.select("q", "home", "qvec").distinct(), vectors.select("u", "vec"), graph, dtype, entries, max(beam, k + 1))
    pairs = found.select("q", F.explode(F.arrays_zip("vs", "ss")).alias("x")).select("q", F.col("x.vs").alias("u"), F.col("x.ss").alias("score"))
    lists = pairs.join(vectors.select("u", "ids"), "u").groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    whole = F.flatten(F.transform("found", lambda x: F.transform(x["ids"], lambda i: F.struct((-x["score"]).alias("s"), i.alias("i")))))
    best = F.slice(F.array_sort(F.filter(whole, lambda x: x["i"] != F.col("query_id"))), 1, k)
    ranked = of.select("query_id", "q").join(lists, "q").select("query_id", F.posexplode(best).alias("p", "x"))
    return ranked.select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))


def _measured(dtype: str):
    """Nodes with the binary logarithm of their lengths."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("length", pa.array(_lengths(_matrix(batch.column("vec"), dtype).astype(np.float64))[1]))

    return run


def _halves(dtype: str):
    """Vectors divided by the upper end of their band, in half precision."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, length = _lengths(_matrix(batch.column("vec"), dtype).astype(np.float64))
                x = (x * np.exp2(length - batch.column("top").to_numpy())[:, None]).astype(np.float16)
                yield pa.record_batch([batch.column("u"), batch.column("band"), pa.array([v.tobytes() for v in x], pa.binary())], ["u", "band", "vec"])

    return run
