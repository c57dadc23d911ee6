"""Lineage over several hops: level by level along the edges, each reached field kept once per seed.

A graph that fits into a worker is sent to all of them and walked there, seed by seed, so that no pair of seed and field is ever shuffled or written
between; for any larger graph each level is a join. Both give the same rows. The pairs are many times the edges, so those of a walk come in an order in
which columns repeat: seeds that reach much the same are walked in one task, and its rows are sorted by field.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.plans.scratch import Scratch
from fieldloom.plans.skew import salted_join


def field_links(edges: DataFrame) -> DataFrame:
    """The distinct links between fields, ``a`` being written from ``b``'s source side: ``a`` (source), ``b`` (target); constants and self-links are none."""
    links = edges.filter("source_field_id IS NOT NULL AND target_field_id IS NOT NULL AND source_field_id <> target_field_id")
    return links.select(F.col("source_field_id").alias("a"), F.col("target_field_id").alias("b")).distinct()


def key_links(edges: DataFrame, fields: DataFrame, upstream: bool = False) -> DataFrame:
    """``key, to``: what the fields of a business key lead to, or with ``upstream`` what leads to them; each once. Links of a field to itself count here.

    fields: ``id, business_key``, unique by id.
    """
    near, far = ("target_field_id", "source_field_id") if upstream else ("source_field_id", "target_field_id")
    keyed = fields.filter("business_key IS NOT NULL").select(F.col("id").alias("_id"), F.col("business_key").alias("key"))
    links = edges.filter("source_field_id IS NOT NULL AND target_field_id IS NOT NULL").select(F.col(near).alias("_near"), F.col(far).alias("to")).distinct()
    return salted_join(links, keyed, [("_near", "_id")], ["to"], "inner").select("key", "to").distinct()


#: A graph up to so many links, with names of so many bytes in all, is walked in the workers (some 40 bytes a link and field there, and the names).
GRAPH_LINKS, GRAPH_BYTES = 8_000_000, 200_000_000
#: In a walk: pairs of seed and field that are looked at together, links followed at once, and rows in a batch of the result.
CELLS, STEP, ROWS = 1 << 24, 1 << 20, 50_000
#: Pairs that are sorted together (at most a level more), as many as a task has about, or at least where there are too few to keep all cores busy.
SORTED, LEAST = 1 << 22, 1 << 18
#: Random draws by which fields are compared: of 16, the sizes are right within about a quarter.
DRAWS = 16


@dataclass
class Graph:
    """The fields in the order of their hashes, and per direction where each one's neighbours begin, and these."""

    names: pa.StringArray
    hashes: np.ndarray
    down: tuple[np.ndarray, np.ndarray]
    up: tuple[np.ndarray, np.ndarray]
    schemas: np.ndarray
    marks: np.ndarray | None = None  # zeros, kept from one walk to the next

    def codes(self, hashes: np.ndarray, names: pa.Array) -> np.ndarray:
        """The numbers of those names that are fields of the graph."""
        if not len(self.hashes):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at[(self.hashes[at] == hashes) & pc.equal(self.names.take(pa.array(at)), names).to_numpy(zero_copy_only=False)]

    def blocks(self, seeds: np.ndarray) -> Iterator[np.ndarray]:
        """The seeds in parts that are walked together."""
        size = max(1, CELLS // max(len(self.hashes), 1))
        return (seeds[i : i + size] for i in range(0, len(seeds), size))

    def walk(self, seeds: np.ndarray, max_depth: int, upstream: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """What is new at each depth from a block of seeds: depth, places of the seeds in the block, fields."""
        begin, to = self.up if upstream else self.down
        n = len(self.hashes)
        seen, self.marks = self.marks, None  # as many fields as a block has would otherwise be zeroed for each block
        if seen is None or len(seen) < len(seeds) * n:
            seen = np.zeros(len(seeds) * n, np.int32)
        level = np.arange(len(seeds), dtype=np.int64) * n + seeds
        marked = []
        for depth in range(1, max_depth + 1):
            new, done = [], 0
            field = level % n
            start, degree = begin[field], begin[field + 1] - begin[field]
            ends = np.cumsum(degree)
            while done < len(level):  # some links at once; a field with more of them is taken alone
                before = int(ends[done - 1]) if done else 0
                upto = max(done + 1, int(np.searchsorted(ends, before + STEP, "right")))
                d = degree[done:upto]
                place = np.arange(int(ends[upto - 1]) - before) + np.repeat(start[done:upto] - (ends[done:upto] - d - before), d)
                pairs = np.repeat(level[done:upto] - field[done:upto], d) + to[place]
                pairs = pairs[seen[pairs] == 0]
                mark = np.arange(1, len(pairs) + 1, dtype=np.int32)
                seen[pairs] = mark
                new.append(pairs[seen[pairs] == mark])  # of equal pairs, one
                done = upto
            level = np.concatenate(new) if new else level[:0]
            if not len(level):
                break
            marked.append(level)
            yield depth, level // n, level % n
        for level in marked:
            seen[level] = 0
        self.marks = seen


def graph_of(links: DataFrame, scratch: Scratch) -> Broadcast[Graph] | bool:
    """The graph of written links ``a, b`` (texts without nulls), sent to the workers; False if it is too large for that."""
    if links.count() > GRAPH_LINKS:
        return False
    ids = scratch.cut(links.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    if (ids.agg(F.sum(F.octet_length("id"))).first()[0] or 0) > GRAPH_BYTES:
        return False
    for seed in range(3):
        table = ids.select(_hash(seed, "id").alias("h"), "id").toArrow()
        order = np.argsort(table["h"].to_numpy())
        hashes = table["h"].to_numpy()[order]
        if (hashes[1:] == hashes[:-1]).any():
            continue  # two fields share a hash
        names = pa.concat_arrays(table["id"].cast(pa.string()).chunks or [pa.array([], pa.string())]).take(pa.array(order))
        del table
        schemas = pc.list_element(pc.split_pattern(names, "#", max_splits=1), 0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        ends = links.select(_hash(seed, "a").alias("a"), _hash(seed, "b").alias("b")).toArrow()
        a, b = (np.searchsorted(hashes, ends[c].to_numpy()).astype(np.int32) for c in ("a", "b"))
        del ends
        ways = [(np.concatenate([[0], np.cumsum(np.bincount(x, minlength=len(hashes)))]), y[np.argsort(x)]) for x, y in ((a, b), (b, a))]
        sent = links.sparkSession.sparkContext.broadcast(Graph(names, hashes, *ways, schemas))
        sent.seed, sent.ways = seed, ways
        scratch.drop(ids)
        return sent
    return False


def _hash(seed: int, column: str):
    return F.xxhash64(F.lit(f"field {seed}"), column)


def _alike(way: tuple[np.ndarray, np.ndarray], seeds: np.ndarray, max_depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The seeds in an order in which those that reach much the same are neighbours, and about how many fields each reaches.

    Each field draws a number, and each seed gets the least of those that it reaches: that of two seeds is equal with a chance of what they share of all
    that they reach (MinHash), and the larger a reach, the smaller its least numbers are. Neither changes any row.
    """
    begin, to = way
    linked = np.flatnonzero(np.diff(begin))
    random, keys, total = np.random.default_rng(0), [], np.full(len(seeds), 1e-9)
    for i in range(DRAWS if len(linked) else 0):
        least, found = random.exponential(size=len(begin) - 1).astype(np.float32), np.full(len(begin) - 1, np.inf, np.float32)
        for _ in range(max_depth - 1):
            before, least[linked] = least[linked], np.minimum(least[linked], np.minimum.reduceat(least[to], begin[linked]))
            if (before == least[linked]).all():
                break
        found[linked] = np.minimum.reduceat(least[to], begin[linked])
        total += found[seeds]
        if i < 3:
            keys.append(found[seeds])
    order = np.lexsort(keys[::-1]) if keys else np.arange(len(seeds))
    return seeds[order], np.minimum((DRAWS - 1) / total, len(begin) - 1)[order]


def _parts(weights: np.ndarray, cores: int) -> np.ndarray:
    """Where the parts of a row of seeds begin and the last one ends, about even in what they reach; a seed costs something besides."""
    ends = np.cumsum(weights + 30)
    total = int(ends[-1]) if len(ends) else 0
    n = max(1, total // SORTED, min(4 * cores, total // LEAST))
    return np.concatenate([[0], np.searchsorted(ends, np.arange(1, n) * (total / n)), [len(ends)]])


def ends(links: DataFrame, upstream: bool = False) -> DataFrame:
    """Ends of the lineage, ``seed``: fields that lead somewhere, but to which nothing leads; with ``upstream``, the other way round."""
    own = links.filter("a IS NOT NULL AND b IS NOT NULL")
    near, far = (own.select(F.col(c).alias("seed")) for c in ("ba" if upstream else "ab"))
    return near.distinct().join(far.distinct(), "seed", "left_anti")


def _codes(graph: Broadcast[Graph], seeds: DataFrame) -> np.ndarray:
    """The seeds that are fields of the graph, by number."""
    own = seeds.filter("seed IS NOT NULL").select(F.col("seed").cast("string").alias("seed")).distinct().select("seed", _hash(graph.seed, "seed").alias("h"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(graph.value.codes(batch.column(1).to_numpy(), batch.column(0).cast(pa.string())), pa.int64())], ["code"])

    return np.sort(own.mapInArrow(find, "code long").toArrow()["code"].to_numpy())  # no more than the graph has fields


def _walked(spark: SparkSession, graph: Broadcast[Graph], seeds: DataFrame | None, max_depth: int, upstream: bool, schema: str, make: Callable[..., Iterator[pa.RecordBatch]]) -> DataFrame:
    if seeds is None:
        on, back = (np.diff(graph.ways[way][0]) for way in (upstream, not upstream))
        codes = np.flatnonzero((on > 0) & (back == 0))
    else:
        codes = _codes(graph, seeds)
    codes, weights = _alike(graph.ways[upstream], codes, max_depth)
    begin = _parts(weights, spark.sparkContext.defaultParallelism)
    sent = spark.sparkContext.broadcast((codes, begin))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                codes, begin = sent.value
                yield from make(graph.value, codes[begin[part] : begin[part + 1]], max_depth, upstream)

    return spark.range(0, len(begin) - 1, 1, len(begin) - 1).mapInArrow(walk, schema)


def _pairs(g: Graph, seeds: np.ndarray, max_depth: int, upstream: bool) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = done = 0
    for block in g.blocks(seeds):
        for depth, of, fields in g.walk(block, max_depth, upstream):
            held.append((fields * len(seeds) + of + done, np.full(len(of), depth, np.int32)))
            n += len(of)
            if n >= SORTED:
                yield from _by_field(g, seeds, held)
                held, n = [], 0
        done += len(block)
    if n:
        yield from _by_field(g, seeds, held)


def _by_field(g: Graph, seeds: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Pairs (field times seeds plus place of the seed, and depth) as rows in the order of the fields: texts that are repeated take next to nothing in files."""
    pairs, depths = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(pairs)
    for i in range(0, len(order), ROWS):
        own = order[i : i + ROWS]
        fields, of = np.divmod(pairs[own], len(seeds))
        from_, to = (g.names.take(pa.array(x)) for x in (seeds[of], fields))
        yield pa.RecordBatch.from_arrays([from_, to, pa.array(depths[own])], ["seed", "field", "depth"])


def _counts(g: Graph, seeds: np.ndarray, max_depth: int, upstream: bool) -> Iterator[pa.RecordBatch]:
    width = int(g.schemas.max(initial=0)) + 1
    for block in g.blocks(seeds):
        n, longest, schemas = np.zeros(len(block), np.int64), np.zeros(len(block), np.int64), np.empty(0, np.int64)
        for depth, of, fields in g.walk(block, max_depth, upstream):
            n += np.bincount(of, minlength=len(block))
            longest[of] = depth
            schemas = np.union1d(schemas, of * width + g.schemas[fields])
        kept = n > 0  # a seed that leads nowhere has no row
        counts = (n, longest, np.bincount(schemas // width, minlength=len(block)))
        yield pa.RecordBatch.from_arrays([g.names.take(pa.array(block[kept])), *[pa.array(x[kept]) for x in counts]], ["seed", "n_fields", "longest", "n_schemas"])


def reach(links: DataFrame, seeds: DataFrame | None, max_depth: int = 6, upstream: bool = False, graph: Broadcast[Graph] | bool | None = None) -> DataFrame:
    """How much ``trace`` reaches from each seed: ``seed, n_fields, longest, n_schemas``, schemas by what stands before the # of a field; counted where it is walked.

    graph: what ``graph_of`` gives for these links, if it is known already.
    """
    graph = _sent(links) if graph is None else graph
    if graph:
        return _walked(links.sparkSession, graph, seeds, max_depth, upstream, "seed string, n_fields long, longest long, n_schemas long", _counts)
    found = _joined(links, seeds, max_depth, upstream, None)
    return found.groupBy("seed").agg(F.count(F.lit(1)).alias("n_fields"), F.max("depth").cast("long").alias("longest"), F.countDistinct(F.substring_index("field", "#", 1)).alias("n_schemas"))


def _sent(links: DataFrame) -> Broadcast[Graph] | bool:
    scratch = Scratch(links.sparkSession)
    return graph_of(scratch.cut(links.filter("a IS NOT NULL AND b IS NOT NULL").select(*[F.col(c).cast("string").alias(c) for c in "ab"])), scratch)


def trace(links: DataFrame, seeds: DataFrame | None, max_depth: int = 6, upstream: bool = False, keys: tuple[DataFrame, DataFrame] | None = None, graph: Broadcast[Graph] | bool | None = None) -> DataFrame:
    """Fields reached from each seed: ``seed, field, depth``, the least number of links, 1 to ``max_depth``; with ``upstream``, against the links.

    seeds: column ``seed``; None stands for all ``ends``, which a graph that is sent already knows. A field that leads back to its seed is reached too, at the depth of the shortest such way. Cycles end where nothing new is
    reached. graph: what ``graph_of`` gives for these links, if it is known already. Levels of joins are written, so a lost executor costs one level at most.

    keys: the fields (``id, business_key``) and what ``key_links`` gives for this direction. From a reached field the way then also goes on from all fields
    of its business key; a seed starts from its own links only. Fields are joined with keys and keys with links, never fields with fields.
    """
    if not keys and (graph := _sent(links) if graph is None else graph):
        return _walked(links.sparkSession, graph, seeds, max_depth, upstream, "seed string, field string, depth int", _pairs)
    return _joined(links, seeds, max_depth, upstream, keys)


def _joined(links: DataFrame, seeds: DataFrame | None, max_depth: int, upstream: bool, keys: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    scratch = Scratch(links.sparkSession)
    step = scratch.cut(links.select(F.col("b" if upstream else "a").alias("_from"), F.col("a" if upstream else "b").alias("_to")))
    if keys:
        key_of = scratch.cut(keys[0].filter("business_key IS NOT NULL").select(F.col("id").alias("_id"), F.col("business_key").alias("_key")))
        key_step = scratch.cut(keys[1].select(F.col("key").alias("_k"), F.col("to").alias("field")))
    frontier = (ends(links, upstream) if seeds is None else seeds).filter("seed IS NOT NULL").select("seed", F.col("seed").alias("field")).distinct()
    reached: DataFrame | None = None
    for depth in range(1, max_depth + 1):
        found = salted_join(frontier, step, [("field", "_from")], ["seed"], "inner").select("seed", F.col("_to").alias("field"))
        if keys and depth > 1:
            own = salted_join(frontier, key_of, [("field", "_id")], ["seed"], "inner").select("seed", "_key").distinct()
            found = found.unionByName(salted_join(own, key_step, [("_key", "_k")], ["seed"], "inner").select("seed", "field"))
        found = found.distinct()
        if reached is not None:
            found = found.join(reached.select("seed", "field"), ["seed", "field"], "left_anti")
        new = scratch.cut(found.withColumn("depth", F.lit(depth)))
        reached = new if reached is None else reached.unionByName(new)
        if new.isEmpty():
            break
        frontier = new.select("seed", "field")
    assert reached is not None
    return reached


def compare_schemas(fields: DataFrame, left: str, right: str) -> DataFrame:
    """Two schemas side by side by business key: ``business_key, left_paths, right_paths``, paths sorted, null where a side has none.

    The names are those of schemas without number and ending, so all their versions take part. Fields without key are left out.
    """
    own = fields.filter("business_key IS NOT NULL").select("business_key", "path", F.regexp_extract("schema_id", "^([A-Za-z0-9]+)_", 1).alias("schema"))
    side = lambda name, as_: own.filter(F.col("schema") == name).groupBy("business_key").agg(F.array_sort(F.collect_set("path")).alias(as_))
    return side(left, "left_paths").join(side(right, "right_paths"), "business_key", "full")


def diff_versions(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of two states by key: ``key, change`` (added, removed or changed); equal ones are left out. Keys are unique in each state; nulls are equal."""
    b = before.select(F.col(key).alias("_b"), F.struct(*columns).alias("_old"))
    a = after.select(F.col(key).alias("_a"), F.struct(*columns).alias("_new"))
    both = b.join(a, F.col("_b") == F.col("_a"), "full")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return both.select(F.coalesce("_b", "_a").alias(key), change.alias("change")).filter("change IS NOT NULL")
