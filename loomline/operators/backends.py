"""Exchangeable parts: embedding backends and text scorers by name, and tools with declared parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline import cluster
from loomline.operators import retrieval


class Backend:
    """Texts (doc_id, text) to unit vectors (doc_id, vector). `fit` learns from a corpus what `embed` needs."""

    name, dim = "base", 0

    def available(self) -> tuple[bool, str]:
        return True, ""

    def fit(self, docs: DataFrame) -> Backend:
        return self

    def embed(self, docs: DataFrame) -> DataFrame:
        raise NotImplementedError

    def info(self) -> dict:
        return {"name": self.name, "dim": self.dim}


class Latent(Backend):
    """Latent semantic vectors of term weights."""

    name = "lsa"

    def __init__(self, dim: int = 64):
        self.dim, self.model = dim, None

    def fit(self, docs: DataFrame) -> Latent:
        self.model = retrieval.lsa_fit(docs, self.dim)
        return self

    def embed(self, docs: DataFrame) -> DataFrame:
        if self.model is None:
            raise ValueError("lsa: fit comes first")
        return retrieval.lsa_embed(self.model, docs)


class Hashed(Backend):
    """Signed counts of words in `dim` buckets by their hash; needs no corpus and no model."""

    name = "hashed"

    def __init__(self, dim: int = 256):
        self.dim = dim

    def embed(self, docs: DataFrame) -> DataFrame:
        from loomline.functions import text as tx

        words = docs.select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("tok"))
        h = F.xxhash64("tok")
        sums = words.groupBy("doc_id", F.pmod(h, F.lit(self.dim)).cast("int").alias("i")).agg(F.sum(F.when(F.shiftrightunsigned(h, 63) == 1, -1.0).otherwise(1.0)).alias("w"))
        rows = sums.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "w"))).alias("m"), (F.sqrt(F.sum(F.col("w") * F.col("w"))) + 1e-12).alias("n"))
        return rows.select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("n")).alias("vector"))


class Encoder(Backend):
    """A model outside Spark: `load()` gives, once a task, a function from a list of texts to a list of vectors. `modules` are
    what it needs to be importable."""

    def __init__(self, name: str, load: Callable, dim: int, modules: Iterable[str] = ()):
        self.name, self.load, self.dim, self.modules = name, load, dim, list(modules)

    def available(self) -> tuple[bool, str]:
        from importlib.util import find_spec

        missing = [m for m in self.modules if find_spec(m) is None]
        return not missing, f"not installed: {', '.join(missing)}" if missing else ""

    def embed(self, docs: DataFrame) -> DataFrame:
        load, kind = self.load, docs.schema["doc_id"].dataType.simpleString()

        def run(batches):
            import numpy as np
            import pyarrow as pa

            encode = load()
            for b in batches:
                made = np.asarray(encode([t or "" for t in b.column(1).to_pylist()]), float).reshape(b.num_rows, -1)
                made = made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(made), pa.list_(pa.float64()))], names=["doc_id", "vector"])

        return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, vector array<double>")


def resolve(backends: list[Backend], prefer: str = "auto") -> Backend:
    """The preferred backend if it is there and available, else the first available one; list them best first."""
    ready = [b for b in backends if b.available()[0]]
    if not ready:
        raise LookupError("; ".join(f"{b.name}: {b.available()[1]}" for b in backends) or "no backend")
    return next((b for b in ready if b.name == prefer.lower()), ready[0])


def search(backend: Backend, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(q, doc_id, score, rank): the k documents whose vectors are most like each query's (doc_id, text)."""
    asked = backend.embed(queries).select(F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("vec_id"), F.col("vector").alias("embedding"))
    asked = cluster.materialize(asked, "queries")  # they are counted and read
    given = backend.embed(docs).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("vec_id"), F.col("vector").alias("embedding"))
    found = retrieval.dense_topk(asked, given, k)
    number = lambda c, of: F.substring(c, 2, 1 << 30).cast(of.schema["doc_id"].dataType)
    return found.select(number("q", queries).alias("q"), number("vec_id", docs).alias("doc_id"), "score", "rank")


@dataclass
class Scorer:
    """A named column function from text to a number or a text, with a card and a check whether it can run."""

    key: str
    apply: Callable[[Column], Column]
    card: dict = field(default_factory=dict)
    check: Callable[[], tuple[bool, str]] = lambda: (True, "")

    def status(self) -> dict:
        try:
            ok, why = self.check()
        except Exception as e:  # a check that fails is an answer
            ok, why = False, str(e)
        return {"key": self.key, "available": ok, "reason": why, **self.card}

    def __call__(self, c: Column) -> Column:
        """Null where the scorer cannot run."""
        return self.apply(c) if self.status()["available"] else F.lit(None)


@dataclass
class Result:
    ok: bool
    value: object = None
    error: str = ""


class Tools:
    """Functions by name with parameters as a JSON schema; a call never raises, but says what is wrong."""

    def __init__(self):
        self.known: dict[str, tuple[Callable, dict]] = {}

    def add(self, name: str, call: Callable, properties: dict, required: Iterable[str] = ()) -> None:
        if name in self.known:
            raise ValueError(f"there is a tool {name}")
        self.known[name] = call, {"type": "object", "properties": properties, "required": list(required)}

    def mount(self, server: str, tools: Tools) -> list[str]:
        """The tools of another registry, under names of their own: mcp_<server>_<tool>."""
        names = []
        for name, (call, schema) in tools.known.items():
            names.append(f"mcp_{server}_{name}")
            self.add(names[-1], call, schema["properties"], schema["required"])
        return names

    def schemas(self) -> list[dict]:
        return [{"name": n, "parameters": s} for n, (_, s) in sorted(self.known.items())]

    def run(self, name: str, /, **given) -> Result:
        if name not in self.known:
            return Result(False, error=f"no tool {name}")
        call, schema = self.known[name]
        missing, odd = [p for p in schema["required"] if p not in given], [p for p in given if p not in schema["properties"]]
        if missing or odd:
            return Result(False, error="; ".join([f"missing: {p}" for p in missing] + [f"unknown: {p}" for p in odd]))
        try:
            return Result(True, call(**given))
        except Exception as e:
            return Result(False, error=f"{type(e).__name__}: {e}")
