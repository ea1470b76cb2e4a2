"""Embedding near-dedup by product quantisation.

Vectors are scaled to length one, so cosine >= c means distance <= reach with
reach = sqrt(2 - 2c). Equal vectors of a label are one class first. Each class
is filed in the inverted list of its label and nearest coarse centroid, with
the residual's code: per subspace the number of the nearest codeword, and the
length of what the code leaves over. A class probes every list that can hold a
vector within reach: by the triangle inequality a member y of list l has
distance <= reach to x only if the bisector between l and x's own list is no
further than reach from x, and x is within reach of the list's largest radius.
These probes are sufficient; none is left out by number.

In a list, table lookups of the probe's residual give its distance to every
code. A member stays a candidate if that distance is at most reach plus the
member's left-over length, so again none within reach is lost; candidates are
reranked by exact cosine in double precision. Lists are cut into blocks of
``BLOCK`` members and ``BLOCK`` probes, each pair of blocks one task's group,
which returns counts and a spanning forest of its links, not the pairs.

Centroids and codewords are fitted on at most ``SAMPLE`` classes, chosen by a
hash; every row is filed.

Defined results: rows whose label is null, or whose vector is null, zero, or
holds null or non-finite components, and vectors of another length than most,
link with nothing and are classes of their own. Rows that repeat an id are
vectors of their own: their links and classes are their vector's, and the
smallest id of a class is its name. A row with
a null id takes no part and has null results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.ann import common_length, matrix, usable
from parlance.llm.common import components, forest, prepare, slices, thinned
from parlance.session import lookup_join, materialize

COSINE = 0.93
BLOCK, SAMPLE = 4_096, 20_000
SUBSPACES, CODEWORDS = 8, 64
LIST_ROWS, MOST_LISTS = 2_048, 4_096
# Distances of rows to centres that are held at once: 8 MB a matrix.
CELLS = 1 << 20


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = owners(x, centres)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre of each row, and all squared distances."""
    d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]
    return d.argmin(1), np.maximum(d, 0)


def owners(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each row, ``CELLS`` distances at a time."""
    step = max(1, CELLS // len(centres))
    return np.concatenate([np.zeros(0, np.int64), *[nearest(x[a:b], centres)[0] for a, b in slices(len(x), step)]])


class Index:
    """Coarse centroids and the codewords of the residuals' subspaces."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.coarse = kmeans(sample, lists, rng)
        residual = sample - self.coarse[owners(sample, self.coarse)]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [kmeans(residual[:, p], CODEWORDS, rng) for p in self.parts]

    def file(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, code, left-over length and distance to the list's centroid of each row."""
        own = owners(x, self.coarse)
        residual = x - self.coarse[own]
        codes = np.stack([owners(residual[:, p], b) for p, b in zip(self.parts, self.books)], 1).astype(np.uint8)
        back = np.hstack([b[codes[:, m]] for m, b in enumerate(self.books)])
        return own, codes, np.linalg.norm(residual - back, axis=1), np.linalg.norm(residual, axis=1)

    def probes(self, x: np.ndarray, reach: float, radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, list) of every list that can hold a vector within reach, of ``CELLS`` distances at a time."""
        for start, end in slices(len(x), max(1, CELLS // len(self.coarse))):
            own, d = nearest(x[start:end], self.coarse)
            # Only the centroids that own a row are set against all of them.
            owning, place = np.unique(own, return_inverse=True)
            apart = np.sqrt(nearest(self.coarse[owning], self.coarse)[1])[place]
            to_own = d[np.arange(len(own)), own][:, None]
            bisector = (d - to_own) <= 2 * reach * apart + 1e-9
            row, which = np.nonzero(bisector & (np.sqrt(d) <= reach + radius[None, :] + 1e-9))
            yield row + start, which

    def distances(self, x: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Squared table-lookup distances of rows to the codes of a list."""
        residual = x - self.coarse[which]
        out = np.zeros((len(x), len(codes)))
        for m, (p, book) in enumerate(zip(self.parts, self.books)):
            out += nearest(residual[:, p], book)[1][:, codes[:, m]]
        return out


def _unit(column, dims: int) -> tuple[np.ndarray, np.ndarray]:
    v = matrix(column, dims).astype(np.float64)
    # Scaled by the largest component first, so that no square leaves the range.
    scaled = v / np.abs(v).max(1, keepdims=True)
    return v, scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def linked(rows: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vec_id, embedding, label``."""
    spark = rows.sparkSession
    prepare(spark)
    rows = rows.select("vec_id", "embedding", "label")
    fit = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    dims = common_length(rows.where(fit)) or 0
    fit = fit & (F.size("embedding") == dims)
    rows = rows.withColumn("class", F.when(fit, F.sha2(F.to_json(F.struct("label", "embedding")), 256)))
    # One row per distinct vector of a label; its copies link with each other.
    classes = materialize(rows.where(F.col("class").isNotNull()).groupBy("class").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"),
        F.first("embedding").alias("embedding"),
    ).withColumn("cid", F.monotonically_increasing_id()), "vectors")
    n = classes.count()
    results = _class_links(classes, n, dims, cosine, block) if n else None
    alone = rows.where(F.col("class").isNull()).select(
        "vec_id", F.when(F.col("vec_id").isNotNull(), 0).cast("long").alias("n_links"),
        F.col("vec_id").alias("component_id"),
    )
    found = alone
    if results is not None:
        members = rows.where(F.col("class").isNotNull()).select("vec_id", "class")
        found = alone.unionByName(members.join(results, "class").select("vec_id", "n_links", "component_id"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _class_links(classes: DataFrame, n: int, dims: int, cosine: float, block: int) -> DataFrame:
    """class, n_links, component_id of every class."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-7
    labels = max(1, classes.select("label").distinct().count())
    sample = thinned(classes, F.col("class"), SAMPLE, n).select("embedding").toArrow().column(0)
    lists = int(min(MOST_LISTS, max(1, n / labels // LIST_ROWS)))
    index = Index(_unit(sample, dims)[1], lists)

    def file(batches):
        for batch in batches:
            own, codes, left, far = index.file(_unit(batch.column(4), dims)[1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()),
                 pa.array(left), pa.array(far)],
                [*batch.schema.names, "list", "code", "left", "far"],
            )

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema)
    filed = materialize(
        classes.mapInArrow(file, f"{shape}, list int, code binary, left double, far double"), "inverted-lists"
    )
    radius = np.zeros(len(index.coarse))
    for r in filed.groupBy("list").agg(F.max("far").alias("far")).collect():  # MOST_LISTS rows at most
        radius[r["list"]] = r["far"]

    def probe(batches):
        for batch in batches:
            for row, which in index.probes(_unit(batch.column(2), dims)[1], reach, radius):
                for start, end in slices(len(row), 20_000):
                    part = batch.take(pa.array(row[start:end]))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(which[start:end].astype(np.int32))], [*batch.schema.names, "list"]
                    )

    kind = classes.schema["embedding"].dataType.simpleString()
    label = classes.schema["label"].dataType.simpleString()
    probes = filed.select("cid", "label", "embedding").mapInArrow(
        probe, f"cid long, label {label}, embedding {kind}, list int"
    )
    # Blocks of a list, by its own counts.
    held = filed.groupBy("label", "list").agg(F.count("*").alias("members"))
    asked = probes.groupBy("label", "list").agg(F.count("*").alias("probes"))
    cuts = materialize(held.join(asked, ["label", "list"]).select(
        "label", "list", F.ceil(F.col("members") / block).cast("int").alias("mb"),
        F.ceil(F.col("probes") / block).cast("int").alias("pb"),
    ), "blocks")
    part = lambda count: F.pmod(F.xxhash64("cid"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    members = filed.join(cuts, ["label", "list"]).withColumn("m", part("mb")).withColumn("p", every("pb")).select(
        "label", "list", "m", "p", "cid", "copies", "embedding", "code", "left"
    )
    asking = probes.join(cuts, ["label", "list"]).withColumn("p", part("pb")).withColumn("m", every("mb")).select(
        "label", "list", "m", "p", "cid", "embedding"
    )
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def compare(own: pa.Table, ask: pa.Table) -> pa.Table:
        """Links of the probes (a, null, count) and a forest of them (a, b, null)."""
        if not len(own) or not len(ask):
            return schema.empty_table()
        which = own.column("list")[0].as_py()
        cid, copies = own.column("cid").to_numpy(), own.column("copies").to_numpy()
        codes = np.frombuffer(b"".join(own.column("code").to_pylist()), np.uint8).reshape(len(cid), -1)
        limit = (reach + own.column("left").to_numpy() + 1e-9) ** 2
        exact, unit = _unit(own.column("embedding"), dims)
        asked_by = ask.column("cid").to_numpy()
        q_exact, q_unit = _unit(ask.column("embedding"), dims)
        size = np.sqrt((exact * exact).sum(1))
        q_size = np.sqrt((q_exact * q_exact).sum(1))
        links = np.zeros(len(asked_by), np.int64)
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start, end in slices(len(asked_by), 256):
            i, j = np.nonzero(index.distances(q_unit[start:end], which, codes) <= limit)
            i += start
            keep = asked_by[i] != cid[j]
            i, j = i[keep], j[keep]
            for x, y in slices(len(i), 200_000):
                a, b = i[x:y], j[x:y]
                with np.errstate(over="ignore", under="ignore", divide="ignore", invalid="ignore"):
                    cos = (q_exact[a] * exact[b]).sum(1) / (q_size[a] * size[b])
                odd = ~np.isfinite(cos)
                if odd.any():  # squares outside the range
                    cos[odd] = (q_unit[a[odd]] * unit[b[odd]]).sum(1)
                hit = cos >= cosine
                np.add.at(links, a[hit], copies[b[hit]])
                us.append(asked_by[a[hit]])
                vs.append(cid[b[hit]])
            if sum(map(len, us)) > 1_000_000:
                u, v = forest(np.concatenate(us), np.concatenate(vs))
                us, vs = [u], [v]
        u, v = forest(np.concatenate(us), np.concatenate(vs))
        some = links > 0
        return pa.concat_tables([
            pa.table({"a": asked_by[some], "b": pa.nulls(int(some.sum()), pa.int64()), "links": links[some]}, schema=schema),
            pa.table({"a": u, "b": v, "links": pa.nulls(len(u), pa.int64())}, schema=schema),
        ])

    keys = ["label", "list", "m", "p"]
    found = members.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(compare, "a long, b long, links long")
    found = materialize(found, "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("others"))
    classes_of = components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "cid")
    out = classes.select("class", "rep", "copies", "cid").join(counts, "cid", "left").join(classes_of, "cid", "left")
    out = materialize(out.select(
        "class", "cid", "rep", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("component", "cid").alias("root"),
    ), "class-links")
    # Vector ids come in only here: the smallest of a component names it. A class without a partner names itself.
    named = out.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("members"))
    names = materialize(named.where("members > 1").drop("members"), "components")
    return lookup_join(out, names, ["root"], "left", F.col("cid")).select(
        "class", "n_links", F.coalesce("component_id", "rep").alias("component_id")
    )
