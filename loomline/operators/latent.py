"""Leading singular vectors of term weights, without the vocabulary on the driver.

A block Krylov method: from a block of hashed directions, each step multiplies the last block by the weights and their
transpose (two joins), and makes the result orthogonal to all blocks before. Terms' rows stay in a table; what reaches the
driver are products of columns, so matrices of a few hundred rows. The singular vectors are the best ones within all blocks
together, and steps end when the leading values no longer change, or when no direction is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline import cluster

cluster.ship_by_value(__name__)

#: Columns in a block beyond those that are asked for, most blocks, and the relative change of values that ends the steps.
EXTRA, STEPS, CHANGE = 8, 30, 1e-12


def columns(batch_column, width: int):
    """An Arrow list column as a matrix."""
    import numpy as np

    return batch_column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def products(table: DataFrame, names: list[str], widths: list[int]):
    """X' X of the columns of all named arrays side by side: one matrix a task, then their sum."""
    import numpy as np

    total = sum(widths)

    def run(batches):
        import pyarrow as pa

        out = np.zeros((total, total))
        for b in batches:
            x = np.concatenate([columns(b.column(i), w) for i, w in enumerate(widths)], axis=1)
            out += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(total), pa.int32()), pa.array(list(out), pa.list_(pa.float64()))], names=["i", "x"])

    rows = table.select(*names).mapInArrow(run, "i int, x array<double>")
    sums = rows.select("i", F.posexplode("x").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    out = np.zeros((total, total))
    for r in sums.collect():  # total ** 2 numbers
        out[r.i, r.j] = r.x
    return out


def changed(table: DataFrame, spans: dict[str, list], widths: dict[str, int]) -> DataFrame:
    """tok and n, and for each name the sum of arrays times matrices: spans[name] is a list of (array, matrix)."""
    names = sorted({a for s in spans.values() for a, _ in s})

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = {a: columns(b.column(2 + i), widths[a]) for i, a in enumerate(names)}
            made = [pa.array(list(sum(x[a] @ m for a, m in spans[k])), pa.list_(pa.float64())) for k in spans]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=["tok", "n", *spans])

    return table.select("tok", "n", *names).mapInArrow(run, "tok string, n long, " + ", ".join(f"{k} array<double>" for k in spans))


def multiplied(weights: DataFrame, block: DataFrame, total: int, width: int) -> DataFrame:
    """tok and c: the weights' transpose times the weights times a block (tok, n, c). Terms that most texts have are looked up
    without a shuffle of their rows; sums are made before rows are dealt out."""
    every = [f"c{j}" for j in range(width)]
    flat = block.select("tok", "n", *[F.col("c")[j].alias(x) for j, x in enumerate(every)])
    met = cluster.lookup(weights, flat, "tok", "n", total, F.struct("doc_id", "tok"))
    by_text = met.groupBy("doc_id").agg(*[F.sum(F.col("w") * F.col(x)).alias(x) for x in every])
    back = weights.join(by_text, "doc_id").groupBy("tok").agg(*[F.sum(F.col("w") * F.col(x)).alias(x) for x in every])
    return back.select("tok", F.array(*every).alias("c"))


def right_vectors(weights: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """(tok, v) of the k leading right singular vectors of the matrix (doc_id, tok, w), fewer if its rank is less, and their
    singular values."""
    import numpy as np

    width = k + EXTRA
    counts = weights.groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    hashed = F.array(*[F.sin((F.pmod(F.xxhash64("tok", F.lit(j)), F.lit(1 << 40)) / F.lit(float(1 << 36)))) for j in range(width)])
    block = cluster.materialize(counts.select("tok", "n", hashed.alias("c")), "start")
    total, terms = weights.count(), block.count()
    if not terms:
        return block.select("tok", F.col("c").alias("v")), []

    def normal(x):
        """Columns that make X orthonormal, from X' X; those without length are left out."""
        values, vectors = np.linalg.eigh((x + x.T) / 2)
        some = values > max(values.max(), 0) * 1e-10
        some &= values > 1e-18 * terms
        return vectors[:, some] / np.sqrt(values[some])

    first = normal(products(block, ["c"], [width]))
    own, m, last, values = None, 0, first.shape[1], np.zeros(0)
    block = cluster.materialize(changed(block, {"c": [("c", first)]}, {"c": width}), "block")
    for step in range(STEPS):
        image = cluster.materialize(multiplied(weights, block, total, last), "image")
        joined = block.join(image.withColumnRenamed("c", "y"), "tok")
        if own is None:
            own = joined.select("tok", "n", F.col("c").alias("v"), F.col("y").alias("z"))
        else:
            own = own.join(joined.select("tok", "c", "y"), "tok").select("tok", "n", F.concat("v", "c").alias("v"), F.concat("z", "y").alias("z"))
        own, m = cluster.materialize(own, "basis"), m + last
        # v' W' W v of all blocks: its values are squares of singular values
        both = products(own, ["v", "z"], [m, m])
        small = both[:m, m:]
        now, turn = np.linalg.eigh((small + small.T) / 2)
        now, turn = now[::-1], turn[:, ::-1]
        done = len(values) >= min(k, len(now)) and np.allclose(now[:k], values[:k], rtol=CHANGE, atol=0)
        values = now
        if done or m >= terms or step + 1 == STEPS:
            break
        # the new block: the last image less its part in all blocks, twice, as differences of nearly equal numbers are inexact
        pick = np.zeros((m, last))
        pick[m - last :] = np.eye(last)
        rest = cluster.materialize(changed(own, {"v": [("v", np.eye(m))], "c": [("z", pick), ("v", -both[:m, 2 * m - last :])]}, {"v": m, "z": m}), "rest")
        length = both[2 * m - last :, 2 * m - last :].trace()
        for _ in range(2):
            g = products(rest, ["v", "c"], [m, last])
            inner = g[m:, m:] - g[:m, m:].T @ g[:m, m:]
            if inner.trace() <= 1e-20 * length:
                last = 0
                break
            make = normal(inner)
            rest = cluster.materialize(changed(rest, {"v": [("v", np.eye(m))], "c": [("c", make), ("v", -g[:m, m:] @ make)]}, {"v": m, "c": last}), "rest")
            last, length = make.shape[1], 0.0
        if not last:
            break
        block = rest.select("tok", "n", "c")
    some = [i for i in range(min(k, len(values))) if values[i] > values[0] * 1e-12]
    out = cluster.materialize(changed(own, {"v": [("v", turn[:, some])]}, {"v": m}).select("tok", "v"), "vectors")
    return out, [float(np.sqrt(values[i])) for i in some]
