"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Equal vectors are folded into one class first. Classes are dealt to shards by hash; each shard builds its graph
by inserting vector after vector: greedy descent through the sparse upper layers, a beam search in the lower ones,
and links to near and mutually different neighbours. Every class then asks every shard: blocks of
queries meet each graph, a beam that holds nothing but links is widened until it does, and the links are
verified by cosine in double precision. Links are joined into components.

Audits compare searches with all vectors of the shard and double the beam until the share of links found reaches ``recall``,
over all links and as the mean of the queries. The first one, when a graph is built, asks for perturbed vectors of the shard, so
it is never empty and sets the beam at which all blocks begin. The second asks some queries of each block, without the
link of a query to itself. Where the beam reaches the size of the graph, the block is compared with all vectors of the shard.

Shards and blocks have bounded sizes, so a task holds one graph and one block however many vectors there are.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own
component; vectors of different lengths do not link; repeated rows and equal vectors link with each other and count as
separate links; a row with a null id lends no link and has a null component; an empty table gives an empty result; an
input column named like a result is replaced.
"""

import hashlib
import heapq
import io
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import packed, unpacked
from tagmill.llm.graph import components
from tagmill.storage import lookup_join, settle


class Settings(NamedTuple):
    least: float = 0.9
    neighbours: int = 16
    build_beam: int = 48
    beam: int = 16
    recall: float = 0.99
    audited: int = 64
    probes: int = 256
    shards: int = 8
    rows_per_shard: int = 20_000


# Single precision is used on the way; this covers its error.
SLACK = 1e-4


class Graph:
    """A navigable small-world graph over unit vectors."""

    def __init__(self, settings: Settings, size: int, width: int):
        self.s, self.most = settings, 2 * settings.neighbours
        self.vectors = np.zeros((size, width), np.float32)
        self.layers: list[dict] = []  # per layer: node -> its neighbours
        self.entry, self.count, self.beam = -1, 0, settings.beam

    def search(self, query, starts, beam: int, layer: dict) -> list[tuple[float, int]]:
        """Up to ``beam`` nearest nodes as (similarity, node), by best-first search."""
        seen = np.zeros(len(self.vectors), bool)
        seen[starts] = True
        found = [(float(s), int(n)) for s, n in zip(self.vectors[starts] @ query, starts, strict=True)]
        open_ = [(-s, n) for s, n in found]
        heapq.heapify(open_)
        heapq.heapify(found)
        while open_:
            near, node = heapq.heappop(open_)
            if -near < found[0][0] and len(found) >= beam:
                break
            around = layer[node]
            around = around[~seen[around]]
            if not len(around):
                continue
            seen[around] = True
            similar = self.vectors[around] @ query
            if len(found) >= beam:
                keep = similar > found[0][0]
                around, similar = around[keep], similar[keep]
            for s, n in zip(similar.tolist(), around.tolist(), strict=True):
                if len(found) < beam:
                    heapq.heappush(found, (s, n))
                elif s > found[0][0]:
                    heapq.heapreplace(found, (s, n))
                else:
                    continue
                heapq.heappush(open_, (-s, n))
        return found

    def chosen(self, found: list[tuple[float, int]], most: int) -> np.ndarray:
        """Near nodes that are nearer to the query than to each other; the nearest fill up."""
        ordered = sorted(found, key=lambda x: (-x[0], x[1]))
        nodes = np.array([n for _, n in ordered], np.int64)
        if len(nodes) <= most:
            return nodes
        among = self.vectors[nodes] @ self.vectors[nodes].T
        kept, left = [], []
        for i, (similar, _) in enumerate(ordered):
            if len(kept) == most:
                break
            (kept if not kept or among[i, kept].max() < similar else left).append(i)
        return nodes[kept + left[: most - len(kept)]]

    def insert(self, vector: np.ndarray, level: int) -> None:
        node = self.count
        self.vectors[node] = vector
        self.count += 1
        top = len(self.layers) - 1
        start = np.array([self.entry])
        if node:
            for at in range(top, level, -1):
                start = np.array([max(self.search(vector, start, 1, self.layers[at]))[1]])
            for at in range(min(level, top), -1, -1):
                layer, most = self.layers[at], self.most if at == 0 else self.s.neighbours
                found = self.search(vector, start, self.s.build_beam, layer)
                layer[node] = self.chosen(found, self.s.neighbours)
                for other in layer[node].tolist():
                    around = np.append(layer[other], node)
                    if len(around) > most:
                        similar = self.vectors[around] @ self.vectors[other]
                        around = self.chosen(list(zip(similar.tolist(), around.tolist(), strict=True)), most)
                    layer[other] = around
                start = np.array([n for _, n in found])
        while len(self.layers) <= level:
            self.layers.append({node: np.empty(0, np.int64)})
            self.entry = node

    def near(self, query: np.ndarray, least: float, beam: int) -> list[int]:
        """Nodes found at ``least`` similarity or more; the beam widens while it holds nothing else."""
        start = np.array([self.entry])
        for layer in self.layers[:0:-1]:
            start = np.array([max(self.search(query, start, 1, layer))[1]])
        while True:
            found = self.search(query, start, beam, self.layers[0])
            if len(found) < beam or found[0][0] < least or beam >= self.count:
                return [n for s, n in found if s >= least]
            beam *= 2

    def dump(self) -> bytes:
        parts = {"vectors": self.vectors, "entry": np.array([self.entry, len(self.layers), self.beam])}
        for at, layer in enumerate(self.layers):
            nodes = np.array(list(layer), np.int64)
            parts[f"nodes{at}"] = nodes
            parts[f"counts{at}"] = np.array([len(layer[n]) for n in nodes], np.int64)
            parts[f"links{at}"] = np.concatenate([layer[n] for n in nodes]).astype(np.int32)
        out = io.BytesIO()
        np.savez(out, **parts)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes, settings: Settings) -> "Graph":
        parts = np.load(io.BytesIO(raw))
        graph = cls(settings, *parts["vectors"].shape)
        graph.vectors, graph.count = parts["vectors"], len(parts["vectors"])
        graph.entry, layers, graph.beam = (int(x) for x in parts["entry"])
        for at in range(layers):
            cuts = np.cumsum(parts[f"counts{at}"])[:-1]
            links = np.split(parts[f"links{at}"].astype(np.int64), cuts)
            graph.layers.append(dict(zip(parts[f"nodes{at}"].tolist(), links, strict=True)))
        return graph


def unit_rows(flat: bytes, width: int) -> np.ndarray:
    """Unit vectors in double precision."""
    rows = np.frombuffer(flat, "<f8").reshape(-1, width)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def built(units: np.ndarray, classes: np.ndarray, settings: Settings) -> Graph:
    graph = Graph(settings, *units.shape)
    scale = 1 / math.log(settings.neighbours)
    draw = np.random.default_rng(len(units))
    levels = np.minimum((-np.log(1 - draw.random(len(units))) * scale).astype(int), 12)
    for row, level in zip(units.astype(np.float32), levels.tolist(), strict=True):
        graph.insert(row, level)
    graph.beam = passing(graph, units, *probes(units, settings), settings)
    return graph


def linked(units: np.ndarray, queries: np.ndarray, least: float) -> list[np.ndarray]:
    """Per query, the nodes linked to it, by comparison with all vectors."""
    found = []
    for start in range(0, len(queries), 256):
        some = queries[start : start + 256]
        near = some @ units.T >= least - SLACK
        found += [verified(units, query, np.flatnonzero(row), least) for query, row in zip(some, near, strict=True)]
    return found


def probes(units: np.ndarray, settings: Settings) -> tuple[np.ndarray, list[np.ndarray]]:
    """Vectors of the shard, turned so that their cosines to themselves fill the range of links, and their links."""
    nodes = np.unique(np.linspace(0, len(units) - 1, min(settings.probes, len(units))).astype(int))
    draw = np.random.default_rng(len(units))
    aside = draw.normal(size=(len(nodes), units.shape[1]))
    aside -= (aside * units[nodes]).sum(axis=1, keepdims=True) * units[nodes]
    length = np.sqrt((aside * aside).sum(axis=1, keepdims=True))
    aside = np.where(length > 1e-9, aside / np.maximum(length, 1e-9), 0)
    cosine = draw.uniform(min(settings.least + SLACK, 1), 1, (len(nodes), 1))
    turned = cosine * units[nodes] + np.sqrt(1 - cosine * cosine) * aside
    turned /= np.sqrt((turned * turned).sum(axis=1, keepdims=True))
    return turned, linked(units, turned, settings.least)


def searched(graph: Graph, units: np.ndarray, queries: np.ndarray, beam: int, least: float) -> list[np.ndarray]:
    return [verified(units, query, graph.near(query.astype(np.float32), least - SLACK, beam), least) for query in queries]


def passing(graph: Graph, units: np.ndarray, queries: np.ndarray, wanted: list[np.ndarray], settings: Settings) -> int:
    """The least beam, from the graph's own by doubling, that finds the links wanted; the graph's size if none does."""
    some = [i for i, nodes in enumerate(wanted) if len(nodes)]
    sizes, beam = np.array([len(wanted[i]) for i in some]), graph.beam
    while some and beam < graph.count:
        found = searched(graph, units, queries[some], beam, settings.least)
        hits = np.array([len(np.intersect1d(nodes, wanted[i])) for nodes, i in zip(found, some, strict=True)])
        if hits.sum() >= settings.recall * sizes.sum() and (hits / sizes).mean() >= settings.recall:
            break
        beam *= 2
    return min(beam, graph.count)


def asked(graph: Graph, units: np.ndarray, queries: np.ndarray, settings: Settings, own: np.ndarray | None = None) -> list[np.ndarray]:
    """Per query, the nodes linked to it. Beams widen until the audit passes, at last to all vectors.

    ``own`` has the node that is the query itself, -1 if the shard has none.
    """
    audited = np.unique(np.linspace(0, len(queries) - 1, min(settings.audited, len(queries))).astype(int))
    wanted = linked(units, queries[audited], settings.least)
    if own is not None:
        wanted = [nodes[nodes != node] for nodes, node in zip(wanted, own[audited], strict=True)]
    beam = passing(graph, units, queries[audited], wanted, settings)
    if beam >= graph.count:
        return linked(units, queries, settings.least)
    return searched(graph, units, queries, beam, settings.least)


def verified(units: np.ndarray, query: np.ndarray, nodes: list[int], least: float) -> np.ndarray:
    nodes = np.array(nodes, np.int64)
    return nodes[units[nodes] @ query >= least] if len(nodes) else nodes


def digests(column: pa.Array) -> pa.Array:
    """Per vector its digest, length and components as doubles; null if it links with nothing."""
    rows = []
    for value in column.to_pylist():
        usable = value and all(x is not None and math.isfinite(x) for x in value) and any(value)
        raw = (np.array(value, "<f8") + 0.0).tobytes() if usable else None
        rows.append((hashlib.blake2b(raw, digest_size=16).digest(), len(value), raw) if usable else (None, None, None))
    kinds = (pa.binary(), pa.int32(), pa.binary())
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["digest", "width", "raw"])


def gathered(classes: DataFrame, parts: int, name: str) -> DataFrame:
    """Classes of one part in one row: their ids and components, end to end."""
    part = F.pmod(F.xxhash64("class", F.lit(name)), F.lit(parts))
    ordered = F.sort_array(F.collect_list(F.struct("class", "raw")))
    grouped = classes.groupBy("width", part.alias(name)).agg(ordered.alias("x"))
    return grouped.select("width", name, F.col("x.class").alias("classes"), F.col("x.raw").alias("raws"))


def graphs(shards: DataFrame, settings: Settings) -> DataFrame:
    """One row per shard with its graph."""

    def build(batches):
        for batch in batches:
            for row in batch.to_pylist():
                units = unit_rows(b"".join(row["raws"]), row["width"])
                graph = built(units, np.array(row["classes"]), settings)
                yield pa.RecordBatch.from_pydict(
                    {"width": pa.array([row["width"]], pa.int32()), "shard": [row["shard"]], "classes": [row["classes"]], "units": [units.tobytes()], "graph": [graph.dump()]}
                )

    return shards.mapInArrow(build, "width int, shard bigint, classes array<bigint>, units binary, graph binary")


def links_of(found: DataFrame, blocks: DataFrame, shards: int, settings: Settings) -> DataFrame:
    """``a, b`` for every class of every block against every graph."""

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                graph = Graph.load(row["graph"], settings)
                units = np.frombuffer(row["units"], np.float64).reshape(-1, row["width"])
                queries = unit_rows(b"".join(row["raws"]), row["width"])
                classes, asking = np.array(row["classes"], np.int64), np.array(row["asking"], np.int64)
                place = np.minimum(np.searchsorted(classes, asking), len(classes) - 1)
                nodes = asked(graph, units, queries, settings, np.where(classes[place] == asking, place, -1))
                a = np.repeat(asking, [len(n) for n in nodes])
                b = classes[np.concatenate(nodes)] if len(nodes) else a
                for start in range(0, len(a), 100_000):
                    left, right = a[start : start + 100_000], b[start : start + 100_000]
                    other = left != right
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)[other]), pa.array(np.maximum(left, right)[other])], names=["a", "b"])

    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint")))
    asks = blocks.withColumnRenamed("classes", "asking").withColumn("shard", every)
    work = asks.join(found, ["width", "shard"]).repartition(shards * shards, "shard", "block")
    return work.mapInArrow(ask, "a bigint, b bigint").distinct()


def near_vectors(rows: DataFrame, vector="embedding", ident="vec_id", settings: Settings = Settings()) -> DataFrame:
    """All input columns with ``n_links, component_id, kept``."""
    digest = F.arrow_udf(digests, "struct<digest:binary,width:int,raw:binary>")
    named = packed(rows).withColumn("id", F.col("doc").getField(ident))
    named = named.withColumn("d", digest(F.col("doc").getField(vector).cast("array<double>")))
    valid = named.where("d.digest IS NOT NULL AND id IS NOT NULL")
    classes = valid.groupBy("d.digest").agg(
        F.min("id").alias("class"), F.count(F.lit(1)).alias("copies"), F.first("d.width").alias("width"), F.first("d.raw").alias("raw")
    )
    classes = settle(classes, "classes")
    shards = max(settings.shards, -(-classes.count() // settings.rows_per_shard))
    # A task asks for one shard or block; both sides are dealt by hash.
    found = settle(graphs(gathered(classes, shards, "shard").repartition(shards, "width", "shard"), settings), "graphs")
    links = settle(links_of(found, gathered(classes, shards, "block"), shards, settings), "links")
    sizes = classes.select("class", "copies")
    ways = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = ways.join(sizes.withColumnRenamed("class", "b"), "b").groupBy(F.col("a").alias("class")).agg(F.sum("copies").alias("others"))
    joined = classes.select("digest", "class", "copies").join(linked, "class", "left")
    if not links.isEmpty():
        joined = joined.join(components(links).withColumnRenamed("node", "class"), "class", "left")
    else:
        joined = joined.withColumn("component", F.lit(None).cast("bigint"))
    facts = joined.select(
        "digest",
        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "class").alias("component_id"),
    )
    facts = facts.where("n_links > 0")
    out = named.withColumn("digest", F.col("d.digest")).drop("d")
    out = lookup_join(out, settle(facts, "facts"), "digest", "left")
    known = F.col("id").isNotNull()
    out = out.withColumn("n_links", F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("bigint"))
    out = out.withColumn("component_id", F.when(known, F.coalesce("component_id", "id")))
    out = out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
    return unpacked(out, ["n_links", "component_id", "kept"])
