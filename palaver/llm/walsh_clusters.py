"""Centroid clustering in whole numbers with a progressive search in the Walsh-Hadamard domain.

Components become integers floor(256 x). The unnormalised Walsh-Hadamard
transform keeps them integers and keeps distances, times the number of
components, so the squared differences of the first coefficients are a lower bound of the
whole sum. Coefficients are ordered coarse to fine, by sign changes. For each vector

1. all centroids get the sum over the first few coefficients, and the nearest by
   these is measured in full: no centroid whose partial sum is larger can win;
2. the rest add coefficients block by block and go out when strictly worse than
   the bound, so ties stay in; those left at the end have all their coefficients.

A round is one Spark job: tasks assign their vectors and add up coefficients by
cluster, Spark sums these, and k rows of sums reach the driver (the transform is linear, so
a centroid's mean is the inverse transform of its sum of coefficients, exactly).

Numbers are exact everywhere: in double precision as long as every sum stays
below 2^53, else as Python integers.

Defined cases: vectors that are null, of another length, or hold a null or
non-finite component take no part; with fewer vectors than centroids there are
as many centroids as vectors; equal vectors may start two centroids, the later of which then stays empty and
where it is; rows without an id take part but start centroids last; rows that repeat count as often as they come; a distance or inertia beyond
a long is null; no vectors give no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import stored, table

SIZE = 64
SCALE = 256
CLUSTERS, ROUNDS, SEED = 40, 5, 2
#: Coefficients after which centroids are thrown out.
STEPS = (4, 8, 16, 32, 64)
#: Components up to here leave all sums of squared coefficient differences below 2^53.
PLAIN = 1 << 18
ROWS = 4096
LIMB = 48
LONG = 1 << 63


def transform(size: int = SIZE):
    """The Walsh-Hadamard matrix of whole numbers, rows by number of sign changes."""
    import numpy as np

    h = np.ones((1, 1), "i8")
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(1), kind="stable")]


def is_plain(coefficients) -> bool:
    """Whether sums of squared differences between such rows and plain vectors are exact in double precision.

    Plain vectors have squares of 2^48 at most; with 2^50 here, those of a difference stay below 2^53.
    """
    return all(sum(int(c) ** 2 for c in row) <= 1 << 50 for row in coefficients)


def nearest(x, c, steps: Sequence[int] = STEPS):
    """For each row of coefficients ``x`` the nearest row of ``c`` and the squared distance of the vectors behind.

    Rows and centroids are arrays of one type, float64 (whole numbers) or object (Python integers).
    """
    import numpy as np

    n, size = x.shape
    first = min(steps[0], size)
    gap = x[:, None, :first] - c[None, :, :first]
    part = (gap * gap).sum(2)
    probe = x - c[part.argmin(1)]
    bound = (probe * probe).sum(1)
    row, col = np.nonzero(part <= bound[:, None])
    held, at = part[row, col], first
    for end in steps[1:]:
        gap = x[row, at:end] - c[col, at:end]
        held = held + (gap * gap).sum(1)
        good = held <= bound[row]
        row, col, held, at = row[good], col[good], held[good], end
    # The survivors have all coefficients: the least sum wins, the smaller number in a tie.
    order = np.lexsort((col, held, row)) if held.dtype != object else np.array(
        sorted(range(len(row)), key=lambda k: (row[k], held[k], col[k])), "i8")
    row, col, held = row[order], col[order], held[order]
    chosen = np.flatnonzero(np.diff(row, prepend=-1))
    return col[chosen], held[chosen] // size


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE) -> DataFrame:
    """id, coefs: transformed whole numbers, 4 bytes each, or decimal digits with commas (plain = false)."""
    v = F.col(vector_col).cast("array<double>")
    fine = (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def transformed(batches):
        import numpy as np
        import pyarrow as pa

        h = transform(size)
        for batch in batches:
            values = batch.column(1).flatten().to_numpy().reshape(-1, size)
            plain = (np.abs(values) < PLAIN / SCALE).all(1)
            coefs = np.floor(np.where(plain[:, None], values, 0) * SCALE).astype("i8") @ h.T
            out = [r.tobytes() for r in coefs.astype("<i4")]
            for k in np.flatnonzero(~plain).tolist():
                whole = [int(x) * SCALE if abs(x) >= 2**53 else int(np.floor(x * SCALE)) for x in values[k].tolist()]
                out[k] = ",".join(str(sum(a * b for a, b in zip(line, whole))) for line in h.tolist()).encode()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plain), pa.array(out, pa.binary())], ["id", "plain", "coefs"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), v.alias("v")).where(fine)
    return rows.mapInArrow(transformed, f"id {kind}, plain boolean, coefs binary")


def _blocks(batch, size: int = SIZE):
    """(rows, coefficients) of a batch with plain and coefs: plain ones together, others as Python integers."""
    import numpy as np

    plain, coefs = batch.column("plain").to_numpy(zero_copy_only=False), batch.column("coefs").to_pylist()
    for start in range(0, len(plain), ROWS):
        held = np.flatnonzero(plain[start : start + ROWS]) + start
        if len(held):
            yield held, np.frombuffer(b"".join([coefs[k] for k in held]), "<i4").reshape(-1, size).astype("f8")
    other = np.flatnonzero(~plain)
    for start in range(0, len(other), 64):
        held = other[start : start + 64]
        yield held, np.array([[int(x) for x in coefs[k].decode().split(",")] for k in held], object)


def _assigned(x, centroids):
    """Cluster and distance of one block against centroids in coefficients (Python integers)."""
    import numpy as np

    if x.dtype != object and is_plain(centroids):
        return nearest(x, centroids.astype("f8"))
    whole = np.array([[int(v) for v in r] for r in x], object) if x.dtype != object else x
    return nearest(whole, centroids)


def _sums(rows: DataFrame, centroids, size: int) -> DataFrame:
    """(cluster, limb, n, s0, s1, ...): sums of coefficients by cluster, in limbs of 48 bits."""

    def added(batches):
        import numpy as np
        import pyarrow as pa

        count, total = [0] * len(centroids), [[0] * size for _ in centroids]
        for batch in batches:
            for held, x in _blocks(batch, size):
                cluster, _ = _assigned(x, centroids)
                for k in np.unique(cluster).tolist():
                    own = x[cluster == k]
                    count[k] += len(own)
                    total[k] = [a + int(b) for a, b in zip(total[k], own.sum(0))]
        out = []
        for k, n in enumerate(count):
            limb, rest = 0, total[k] if n else None
            while n and (limb == 0 or any(rest)):
                low = [v & ((1 << LIMB) - 1) for v in rest] if any(abs(v) >> LIMB for v in rest) else rest
                out.append((k, limb, n if limb == 0 else 0, *low))
                rest, limb = [(v - w) >> LIMB for v, w in zip(rest, low)], limb + 1
        names = ["cluster", "limb", "n", *[f"s{j}" for j in range(size)]]
        columns = list(zip(*out)) or [[]] * len(names)
        types = [pa.int32(), pa.int32(), *[pa.int64()] * (size + 1)]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    fields = ", ".join(["cluster int", "limb int", "n long", *[f"s{j} long" for j in range(size)]])
    whole = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ["n", *[f"s{j}" for j in range(size)]]]
    return rows.select("plain", "coefs").mapInArrow(added, fields).groupBy("cluster", "limb").agg(*whole)


def _starts(rows: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """Coefficients of the first centroids: the rows with the least hashes."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    chosen = rows.orderBy(F.asc_nulls_last(drawn), "coefs").limit(clusters).select("plain", "coefs").collect()
    import numpy as np

    return [np.frombuffer(c, "<i4").tolist() if plain else [int(x) for x in bytes(c).decode().split(",")] for plain, c in chosen]


def cluster(
    df: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    size: int = SIZE,
) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and the digest of the cluster's centroid, for every vector kept."""
    import hashlib

    import numpy as np

    spark = df.sparkSession
    h = transform(size).tolist()
    changed = lambda values: [sum(a * b for a, b in zip(line, values)) for line in h]
    back = lambda values: [sum(h[i][j] * values[i] for i in range(size)) // size for j in range(size)]
    rows = stored(vectors(df, id_col, vector_col, size), "coefficients")
    centroids = [back(c) for c in _starts(rows, clusters, seed)]
    for _ in range(rounds):
        if not centroids:
            break
        found: dict[int, list] = {}
        for r in _sums(rows, np.array([changed(c) for c in centroids], object), size).collect():
            held = found.setdefault(r["cluster"], [0, [0] * size])
            held[0] += int(r["n"])
            held[1] = [a + (int(r[f"s{j}"]) << (LIMB * r["limb"])) for j, a in enumerate(held[1])]
        for k, (n, total) in found.items():
            centroids[k] = [t // n for t in back(total)]
    final = np.array([changed(c) for c in centroids], object).reshape(-1, size)

    def placed(batches):
        import pyarrow as pa

        for batch in batches:
            cluster, distance = [0] * batch.num_rows, [None] * batch.num_rows
            for held, x in _blocks(batch, size):
                for k, c, d in zip(held.tolist(), *[a.tolist() for a in _assigned(x, final)]):
                    cluster[k], distance[k] = c, int(d) if d < LONG else None
            columns = [batch.column("id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "cluster", "distance"])

    kind = df.schema[id_col].dataType.simpleString()
    labelled = stored(rows.mapInArrow(placed, f"id {kind}, cluster int, distance long"), "clusters")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = labelled.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), exact).alias("own"))
    total = F.expr("case when count(own) over () = count(*) over () then sum(own) over () end")  # k rows
    digests = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids)]
    digests = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    named = sums.select("cluster", F.expr("try_cast(own as bigint)").alias("cluster_inertia"), total.alias("whole"))
    named = named.withColumn("inertia", F.expr("try_cast(whole as bigint)")).drop("whole").join(F.broadcast(digests), "cluster")
    # A row for each centroid.
    return labelled.join(F.broadcast(named), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op12_walsh_clusters(spark, sf_dir):
    return cluster(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """Distances written out over components, one pair of steps for each round."""
    gap = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    sql = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS k, v AS c FROM (
    SELECT sha256('{SEED}:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {CLUSTERS}))"""
    for i in range(ROUNDS + 1):
        sql += f""",
a{i} AS MATERIALIZED (
  SELECT row, min(struct_pack(d := d, k := k)) AS best FROM (SELECT row, k, {gap} AS d FROM kept, c{i}) GROUP BY row)"""
        if i < ROUNDS:
            sql += f""",
s{i} AS MATERIALIZED (
  SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS c FROM (
    SELECT k, j, sum(x)::BIGINT AS s, count(*) AS n FROM (
      SELECT best.k AS k, unnest(v) AS x, unnest(range({SIZE})) AS j FROM kept JOIN a{i} USING (row)) GROUP BY k, j) GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT k, coalesce(s{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN s{i} USING (k))"""
    return sql + f"""
SELECT vec_id, best.k AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia,
       (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM kept JOIN a{ROUNDS} USING (row) JOIN c{ROUNDS} ON k = best.k
"""


ORACLE = _oracle()
