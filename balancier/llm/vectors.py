"""Near-duplicate vectors by randomised-rotation binary codes.

Every vector is rotated at random a few times and keeps the signs, and for each rotation the
factor that makes the inner product of the signs with another vector an unbiased estimate of
the cosine. Runs of sign bits are the keys on which vectors meet. First those that meet are
compared with a few leaders by the estimates; a pair whose confidence bound reaches the threshold
is computed exactly. Then every two vectors of a key that this leaves in different components are
compared in blocks, by bounds that hold always. The links of a component are counted exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from balancier.llm import words as W
from balancier.llm.common import NULL_ID, kept, null_ids
from balancier.llm.components import components

THRESHOLD = 0.9
#: Chance that a pair just at the threshold meets in some table.
RECALL = 0.995
#: Vectors that share a table's key by chance, on average.
CROWD = 32
#: Standard errors between an estimate and its bound.
SURE = 4.0
#: Vectors of a key or a component that are compared with each other in one step.
SIDE = 1024


def tables(count: int, threshold: float) -> tuple[int, int]:
    """Bits of a key and number of tables for so many vectors."""
    bits = max(4, math.ceil(math.log2(max(2, count) / CROWD)))
    met = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - met))


def rotations(dim: int, wanted: int) -> np.ndarray:
    """Random rotations, the same in every task, with at least ``wanted`` sign bits together."""
    random = np.random.default_rng([dim, 77])
    return np.array([np.linalg.qr(random.standard_normal((dim, dim)))[0] for _ in range(max(1, -(-wanted // dim)))])


def usable(lists: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors; None for those that are null, empty, zero or hold null or non-finite components."""
    out: list[np.ndarray | None] = []
    for v in lists:
        x = None if v.as_py() is None else np.array(v.as_py(), dtype=object)
        if x is None or not len(x) or any(c is None for c in x):
            out.append(None)
            continue
        x = x.astype("f8")
        top = np.abs(x).max()
        if not np.isfinite(top) or top == 0:
            out.append(None)
            continue
        x = x / top  # so that squares of very large or small components stay in range
        out.append(x / np.linalg.norm(x))
    return out


def _read(vectors: DataFrame) -> DataFrame:
    """``vec_id, digest, unit``: unit vectors, and the digest of their values; both null where unusable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = usable(batch.column("embedding"))
            digests = [None if u is None else hashlib.md5(u.tobytes()).digest() for u in units]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(digests, pa.binary()), pa.array(units, pa.list_(pa.float64()))],
                ["vec_id", "digest", "unit"],
            )

    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("vec_id"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(run, "vec_id long, digest binary, unit array<double>")


def _small(unit: np.ndarray) -> tuple[float, np.ndarray]:
    """A vector in steps of a scale."""
    scale = float(np.abs(unit).max() / 127)
    return scale, np.rint(unit / scale).astype("i1")


def codes(classes: DataFrame, bits: int, count: int) -> DataFrame:
    """``key, node, code, factors, scale, small``: a row for each table of every vector.

    ``code`` has the signs of all rotations, ``factors`` the corrections, and ``small`` the
    vector itself in steps of ``scale``, for the other side of the estimate.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = []
            for node, unit in zip(batch.column("node").to_pylist(), batch.column("unit").to_pylist()):
                x = np.array(unit)
                dim = len(x)
                if dim not in turns:
                    turns[dim] = rotations(dim, bits * count)
                turned = turns[dim] @ x
                signs = (turned >= 0).ravel()
                factors = np.abs(turned).sum(axis=1) / math.sqrt(dim)
                scale, small = _small(x)
                small = small.tobytes()
                packed = np.packbits(signs).tobytes()
                own = np.zeros((count, 64), "u1")
                own[:, 64 - bits :] = signs[: bits * count].reshape(count, bits)
                value = np.packbits(own, axis=1).view(">u8").ravel().astype("u8")
                salt = W.mix(np.arange(count, dtype="u8") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim))
                for key in W.mix(value ^ salt).view("i8").tolist():
                    rows.append((key, node, packed, factors.astype("f4").tobytes(), scale, small))
            if rows:
                types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.binary())
                names = ["key", "node", "code", "factors", "scale", "small"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    schema = "key long, node long, code binary, factors binary, scale double, small binary"
    return classes.select("node", "unit").mapInArrow(run, schema)


class _Leaders:
    """Vectors of one key that later ones are compared with."""

    def __init__(self, turns: np.ndarray):
        self.turns, self.dim = turns, turns.shape[1]
        self.nodes: list[int] = []
        self.signs = np.empty((16, turns.shape[0], self.dim), "f4")
        self.factors = np.empty((16, turns.shape[0]), "f4")

    def estimates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cosine of every leader with ``x``, from the leaders' signs, and how far it may be off."""
        n, turns = len(self.nodes), len(self.turns)
        factors = self.factors[:n]
        each = np.einsum("ntd,td->nt", self.signs[:n], (self.turns @ x).astype("f4")) / math.sqrt(self.dim) / factors
        spread = np.maximum(0, 1 - factors**2) / factors**2 / max(1, self.dim - 1)
        return each.mean(axis=1), SURE * np.sqrt(spread.sum(axis=1)) / turns + 0.01

    def add(self, node: int, signs: np.ndarray, factors: np.ndarray) -> None:
        n = len(self.nodes)
        if n == len(self.signs):
            self.signs, self.factors = (np.concatenate([x, np.empty_like(x)]) for x in (self.signs, self.factors))
        self.nodes.append(node)
        self.signs[n], self.factors[n] = signs.reshape(self.turns.shape[:2]), factors


def meet(coded: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a, b`` that share a key and whose bound reaches the threshold: a first pass, not all of them.

    Within a key a vector is compared with those leading before it: it names the first that may
    be near and the likeliest, and leads too unless one is near by the estimate. Rows are dealt out
    by ranges of key and id: a crowded key is cut into ranges, at other places in every table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leaders, seen = None, None, set()
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                dim, factors = len(row["small"]), np.frombuffer(row["factors"], "f4")
                if dim not in turns:
                    turns[dim] = rotations(dim, len(factors) * dim)
                if row["key"] != key or leaders.dim != dim:
                    key, leaders = row["key"], _Leaders(turns[dim])
                x = np.frombuffer(row["small"], "i1") * row["scale"]
                near = False
                if leaders.nodes:
                    found, off = leaders.estimates(x)
                    may = np.flatnonzero(found + off >= threshold)
                    if len(may):
                        for i in {int(may[0]), int(may[np.argmax(found[may])])}:
                            seen.add((leaders.nodes[i], row["node"]))
                        near = found[may].max() >= threshold
                if not near:
                    signs = np.unpackbits(np.frombuffer(row["code"], "u1"))[: len(factors) * dim].astype("f4") * 2 - 1
                    leaders.add(row["node"], signs, factors)
            if len(seen) > 100_000:
                yield _pairs(seen)
                seen = set()
        if seen:
            yield _pairs(seen)

    dealt = coded.repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _pairs(seen: set[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*seen)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def smalls(classes: DataFrame) -> DataFrame:
    """``node, small, scale, off``: vectors in steps of ``scale``, and how far that is from the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [np.array(u) for u in batch.column("unit").to_pylist()]
            scaled = [_small(u) for u in units]
            off = [float(np.linalg.norm(u - scale * small)) for u, (scale, small) in zip(units, scaled)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([x.tobytes() for _, x in scaled], pa.binary()), pa.array([x for x, _ in scaled], pa.float64()),
                 pa.array(off, pa.float64())],
                ["node", "small", "scale", "off"],
            )

    return classes.select("node", "unit").mapInArrow(run, "node long, small binary, scale double, off double")


def apart(groups: DataFrame, small: DataFrame) -> DataFrame:
    """Members of the keys that hold more than one component, in blocks of about ``SIDE`` vectors.

    ``groups`` has ``key, node, component``. A component of more than ``SIDE`` vectors of a key has
    blocks of its own there, the others share theirs. Each block is compared with every block,
    but not with those of the same large component.
    """
    sizes = groups.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    large = F.col("n") > SIDE
    blocks = F.ceil(F.col("n") / SIDE).cast("int").alias("blocks")
    mixed = sizes.groupBy("key").agg(
        F.count(F.lit(1)).alias("parts"),
        F.collect_list(F.when(large, F.struct(F.col("component").alias("owner"), blocks))).alias("large"),
        F.ceil(F.sum(F.when(large, 0).otherwise(F.col("n"))) / SIDE).cast("int").alias("shared"),
    )
    rows = groups.join(mixed.where("parts > 1").drop("parts"), "key")
    own = F.filter("large", lambda x: x["owner"] == F.col("component"))
    rows = rows.withColumn("own", F.when(F.size(own) > 0, own[0]))
    name = lambda owner, i: F.concat_ws(":", owner, i)
    named = lambda owner, n: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: name(owner, i))).otherwise(F.array().cast("array<string>"))
    others = F.filter("large", lambda x: F.col("own").isNull() | (x["owner"] != F.col("component")))
    others = F.flatten(F.transform(others, lambda x: named(x["owner"].cast("string"), x["blocks"])))
    others = F.concat(others, named(F.lit("shared"), F.col("shared")))
    home = name(F.coalesce(F.col("own.owner").cast("string"), F.lit("shared")), F.pmod(F.xxhash64("node"), F.coalesce("own.blocks", "shared")))
    rows = rows.select("key", "node", "component", home.alias("home"), F.explode(others).alias("other"))
    group = F.concat_ws("/", "key", F.least("home", "other"), F.greatest("home", "other"))
    side = F.when(F.col("home") > F.col("other"), 1).otherwise(0)
    rows = rows.select(group.alias("group"), side.alias("side"), "node", "component")
    return rows.join(small, "node").repartition("group").sortWithinPartitions("group")


def near(members: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a, b`` of different components within a group of ``apart`` that join all that links there.

    Cosines of the scaled vectors are off by no more than these are, so a pair is a link for
    sure, is none, or is left to be computed. Of the sure links those that join two components
    are named; of the others each pair that these leave apart.
    """

    def compare(held: list[dict]) -> list[tuple[int, int]]:
        out = []
        for dim in {len(r["small"]) for r in held}:
            rows = [r for r in held if len(r["small"]) == dim]
            part = np.unique(np.array([r["component"] for r in rows], "i8"), return_inverse=True)[1]
            if not part.any():
                continue
            node, side = (np.array([r[k] for r in rows], "i8") for k in ("node", "side"))
            scale, off = (np.array([r[k] for r in rows]) for k in ("scale", "off"))
            units = np.frombuffer(b"".join(r["small"] for r in rows), "i1").reshape(len(rows), dim) * scale[:, None]
            cosine = units @ units.T
            slack = off[:, None] + off + off[:, None] * off + 1e-9
            may = np.triu(cosine + slack >= threshold, 1)
            if side.any():
                may &= side[:, None] != side
            sure = may & (cosine - slack >= threshold)
            links = []
            for i in range(len(rows)):
                at = np.flatnonzero(sure[i] & (part != part[i]))
                while len(at):
                    links.append((i, int(at[0])))
                    part[part == part[at[0]]] = part[i]
                    at = at[part[at] != part[i]]
            links += np.argwhere(may & ~sure & (part[:, None] != part)).tolist()
            out += [(min(a, b), max(a, b)) for a, b in ((int(node[i]), int(node[j])) for i, j in links)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, seen = None, [], set()
        for batch in batches:
            for row in batch.to_pylist():
                if row["group"] != group:
                    seen.update(compare(held))
                    group, held = row["group"], []
                    if len(seen) > 100_000:
                        yield _pairs(seen)
                        seen = set()
                held.append(row)
        seen.update(compare(held))
        if seen:
            yield _pairs(seen)

    return members.mapInArrow(run, "a long, b long").distinct()


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def verified(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose cosine, computed exactly, is ``threshold`` or more."""
    left = classes.select(F.col("node").alias("a"), F.col("unit").alias("ua"))
    right = classes.select(F.col("node").alias("b"), F.col("unit").alias("ub"))
    met = pairs.join(left, "a").join(right, "b").where(F.size("ua") == F.size("ub"))
    return met.where(_dot("ua", "ub") >= threshold).select("a", "b")


def counted(members: DataFrame, threshold: float) -> DataFrame:
    """``node, others``: for each member the vectors of its component that it links with, itself not.

    ``members`` has ``component, node, unit, copies``. A component of more than ``SIDE`` vectors is
    compared block by block, in as many steps as it has pairs of blocks. A vector's copies link too.
    """
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    blocks = sizes.select("component", F.ceil(F.col("size") / SIDE).cast("int").alias("blocks"))
    rows = members.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("component", "node", "unit", "copies", "block", other)
    group = F.concat_ws("/", "component", F.least("block", "other"), F.greatest("block", "other"))
    side = F.when(F.col("block") > F.col("other"), 1).otherwise(0)
    rows = rows.select(group.alias("group"), side.alias("side"), "node", "unit", "copies")

    def compare(held: list[dict]) -> tuple[list[int], np.ndarray]:
        held.sort(key=lambda r: (len(r["unit"]), r["node"]))
        total = np.zeros(len(held), "i8")
        for dim in {len(r["unit"]) for r in held}:
            own = np.array([i for i, r in enumerate(held) if len(r["unit"]) == dim])
            units = np.array([held[i]["unit"] for i in own])
            copies, sides = (np.array([held[i][k] for i in own], "i8") for k in ("copies", "side"))
            linked = units @ units.T >= threshold
            np.fill_diagonal(linked, True)
            if sides.any():
                linked &= sides[:, None] != sides
            total[own] = linked @ copies
        return [r["node"] for r in held], total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["group"] != group and held:
                    nodes, total = compare(held)
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(total)], ["node", "n"])
                    held = []
                group = row["group"]
                held.append(row)
        if held:
            nodes, total = compare(held)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(total)], ["node", "n"])

    dealt = rows.repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(run, "node long, n long").groupBy("node").agg((F.sum("n") - 1).alias("others"))


def near_duplicates(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector, linked by cosine.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing,
    nor do vectors of different lengths. Equal vectors are one class, compared once. A null id
    counts as the smallest; rows that share an id are separate vectors of one component if they
    link. Pairs below the threshold are never linked; of those just at it ``RECALL`` meet.
    """
    read = kept(spark, _read(vectors))
    sound = read.where(F.col("digest").isNotNull())
    groups = sound.groupBy("digest").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    one = groups.join(sound.select("digest", F.col("vec_id").alias("node"), "unit"), ["digest", "node"]).dropDuplicates(["digest"])
    classes = kept(spark, one)
    bits, count = tables(classes.count(), threshold)
    coded = codes(classes, bits, count)
    links = kept(spark, verified(meet(coded, threshold), classes, threshold))
    parts = components(spark, links)
    met = coded.select("key", "node").join(parts, "node", "left")
    groups = kept(spark, met.select("key", "node", F.coalesce("component", "node").alias("component")))
    pairs = near(apart(groups, smalls(classes)), threshold)
    links = links.unionByName(verified(pairs, classes, threshold))
    parts = kept(spark, components(spark, links))
    others = counted(classes.join(parts, "node"), threshold)
    found = classes.select("digest", "node", "copies").join(parts, "node", "left").join(others, "node", "left")
    found = found.select(
        "digest", F.coalesce("others", F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    )
    linked = read.select("vec_id", "digest").join(found, "digest", "left")
    own = F.coalesce("component_id", "vec_id")
    return null_ids(
        linked.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"), (F.col("vec_id") == own).alias("kept")),
        "vec_id", "component_id",
    )
