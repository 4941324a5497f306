"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint's 32 two-bit segments are mapped to their bit counts. The Manhattan distance of two count vectors never
exceeds the Hamming distance of the fingerprints, so a range join on the grid of counts finds every pair within the
radius; the exact distance is checked afterwards. The grid is cut into g blocks of coordinates: if the Manhattan distance
is 2 or less, at least g - 2 blocks agree, so the join is an equi-join on each choice of g - 2 blocks.

A grid cell with more than CELL fingerprints is not expanded into pairs. Its members are linked exactly in another way:
each fingerprint names the 65 values within one bit of it, and two fingerprints share such a value if and only if they
differ in 2 bits or fewer. A value has at most 65 fingerprints, so the work stays proportional to the fingerprints.

The pipeline stage takes its first candidates from the same fingerprints, grid and links, checks each by the sets of five-word
shingles and keeps one text of each group. It then looks wider: texts whose sets have a Jaccard similarity of 0.8 or more
differ in 9.7 bits of 64 on average, in up to 18 (one in 200), and no grid of fingerprints is selective at such a radius. So
texts that stay and share a band of minima of the shingle hashes are candidates too, and checked in the same way.

Defined cases: null or empty text and text without a word have fingerprint 0, which links like any other, and
are copies of each other in the stage; repeated rows
stay repeated; a null doc_id is kept and never is a component_id unless a component has no other; an empty table gives an
empty result; texts of any length are read whole; columns other than doc_id and text are not read by the query and kept by the
stage, where of rows equal in doc_id and text any one stays.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline import cluster
from loomline.llm import _scan

cluster.ship_by_value(__name__)

RADIUS = 2
#: Fingerprints of a grid cell that are paired one by one.
CELL = 32
SHINGLE = 3
SEED = 42
#: Near copies of the pipeline stage: words of a shingle, least Jaccard similarity of the sets of shingles, bands of minima.
WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 5
#: Cells, candidates or decisions (under 50 bytes each) that are broadcast at most.
BROADCAST_KEYS = 300_000
#: Nodes with their labels, fingerprints with their keys or heads of groups (about 100 bytes each) that are broadcast at most.
BROADCAST_NODES = 100_000


def fingerprint(raw: bytes, k: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the XXH64 of all k-word shingles of UTF-8 text."""
    import numpy as np
    import xxhash

    words = raw.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    if not words:
        return 0
    text, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(k, len(words))
    hashes = np.fromiter((digest(text[s:e], seed) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())), np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches):
    import numpy as np
    import pyarrow as pa

    for batch in _scan.slices(batches):
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        found = np.fromiter((fingerprint(t) if t else 0 for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, a fingerprint as a signed long, for each row of docs."""
    return _scan.over(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _fingerprint_batches, "doc_id long, fp long")


def embed(fp):
    """Bit counts of the 32 two-bit segments in unary: 00, 01 or 11. XOR and a bit count give Manhattan distances."""
    odd, high = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(high).bitwiseAND(odd).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(odd), 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def block_masks(blocks: int) -> list[int]:
    """For each choice of all but RADIUS blocks, the mask of their coordinates."""
    edges = [round(32 * i / blocks) for i in range(blocks + 1)]
    own = [sum(3 << (2 * s) for s in range(edges[i], edges[i + 1])) for i in range(blocks)]
    return [_signed(sum(own[i] for i in kept)) for kept in combinations(range(blocks), blocks - RADIUS)]


def blocks_for(n: int) -> int:
    """Enough blocks that unrelated fingerprints seldom share a cell; .375 is the chance that two segments agree."""
    for g in (5, 6, 8, 10):
        keys = g * (g - 1) / 2
        if n * keys / 2 * 0.375 ** (32 * (g - RADIUS) / g) <= 1:
            return g
    return 12


def links(distinct: DataFrame, n: int) -> DataFrame:
    """Links u < v between the distinct fingerprints in column fp: enough of them to join all that are within RADIUS."""
    masks = block_masks(blocks_for(n))
    cells = distinct.select("fp", embed(F.col("fp")).alias("e")).select(
        "fp", "e", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("e").bitwiseAND(F.lit(m)).alias("c")) for i, m in enumerate(masks)])).alias("cell"))
    cells = cells.select("fp", "e", F.col("cell.i").alias("i"), F.col("cell.c").alias("c"))
    sizes = cells.groupBy("i", "c").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cluster.materialize(cells.join(sizes, ["i", "c"]), "cells")
    small = shared.where(F.col("n") <= CELL)
    a, b = small.select("i", "c", F.col("fp").alias("u"), F.col("e").alias("eu")), small.select("i", "c", F.col("fp").alias("v"), F.col("e").alias("ev"))
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("eu").bitwiseXOR(F.col("ev"))) <= RADIUS) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)
    pairs = a.join(b, ["i", "c"]).where(near).select("u", "v")
    flips = [0] + [_signed(1 << k) for k in range(64)]
    dense = shared.where(F.col("n") > CELL).select("fp").distinct()
    balls = dense.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m)) for m in flips])).alias("centre"))
    stars = balls.groupBy("centre").agg(F.collect_list("fp").alias("near")).where(F.size("near") > 1)
    stars = stars.select(F.array_min("near").alias("u"), F.explode("near").alias("v")).where("u < v")
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame, total: int) -> DataFrame:
    """node and label, its component's smallest node, for the nodes of the links u, v. Each round takes the least label of
    the neighbours and, if any changed, then the label's own label; a round in which no neighbour has a smaller one is the
    last. Few nodes are broadcast, so that a round is one shuffle."""
    both = cluster.materialize(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "links")
    state = last = cluster.materialize(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    few = state.count() <= BROADCAST_NODES
    while True:
        known = F.broadcast(state) if few else state
        least = both.join(known, F.col("u") == F.col("node")).groupBy(F.col("v").alias("dst")).agg(F.min("label").alias("m"))
        hooked = cluster.materialize(least.join(known, F.col("dst") == F.col("node")).select("node", F.col("label").alias("was"), F.least("label", "m").alias("label")), "hooked")
        cluster.drop(last)
        if not hooked.where("label < was").limit(1).count():
            cluster.drop(both)
            return hooked.select("node", "label")
        # labels that have a smaller one themselves
        jump = hooked.where("label < node").select(F.col("node").alias("label"), F.col("label").alias("up"))
        if few:
            jumped = hooked.join(F.broadcast(jump), "label", "left")
        else:
            uses = hooked.groupBy("label").agg(F.count(F.lit(1)).alias("uses"))
            jumped = cluster.lookup(hooked, jump.join(uses, "label"), "label", "uses", total, F.col("node"))
        state = jumped.select("node", F.coalesce("up", "label").alias("label"))
        last = hooked
        if not few:
            state = last = cluster.materialize(state, "labels")
            cluster.drop(hooked)


def _named(own: DataFrame, distinct: DataFrame, labels: DataFrame, n: int, key: str) -> DataFrame:
    """own with component_id, the least doc_id of the component of its key. distinct: key, rep and rows; labels: node, label."""
    named = distinct.join(labels, distinct[key] == labels.node, "left").select(key, "rep", "rows", F.coalesce("label", key).alias("label"), F.col("label").isNotNull().alias("linked"))
    named = cluster.materialize(named, "named")
    least = named.where("linked").groupBy("label").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("fps"))
    linked = cluster.lookup(named.where("linked"), least, "label", "fps", n, F.col(key)).select(key, "rows", "component_id")
    alone = named.where("not linked").select(key, "rows", F.col("rep").alias("component_id"))
    return cluster.lookup(own, linked.unionByName(alone), key, "rows", own.count(), F.col("doc_id"))


def close_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed long) and component_id, by fingerprints within RADIUS, of each row of docs."""
    own = cluster.materialize(fingerprints(docs), "fingerprints")
    distinct = cluster.materialize(own.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")), "distinct")
    n = distinct.count()
    return _named(own, distinct, components(links(distinct, n), n), n, "fp")


class Shingler:
    """64-bit hashes of k-word shingles of many texts at once, by prefix sums (see _scan)."""

    def __init__(self, k: int = WORDS):
        self.k, self.hasher, self.space = k, _scan.Hasher(), _scan.byte_classes() == _scan.SPACE

    def words(self, raws: list[bytes]):
        """Hashes of the words of all texts, A-Z lower-cased, and the bounds of each text's words."""
        import numpy as np

        hashes, counts, at, buffer = [], np.zeros(len(raws), np.int64), 0, []

        def flush():
            nonlocal buffer
            if buffer:
                buf = np.frombuffer(b"\n".join(r for _, r in buffer), np.uint8)
                buf = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
                starts, ends, _ = _scan.runs(self.space[buf], [False])
                hashes.append(self.hasher.spans(buf, starts, ends))
                edges = np.cumsum([0] + [len(r) + 1 for _, r in buffer])
                np.add.at(counts, [i for i, _ in buffer], np.diff(np.searchsorted(starts, edges)))
                buffer = []

        size = 0
        for i, raw in enumerate(raws):
            at = 0
            while at < len(raw):  # very long texts in pieces that end at white space
                end = min(len(raw), at + (1 << 20))
                while end < len(raw) and not self.space[raw[end]]:
                    end += 1
                buffer.append((i, raw[at:end]))
                size, at = size + end - at, end
                if size > 1 << 19:
                    flush()
                    size = 0
        flush()
        return np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate([[0], np.cumsum(counts)])

    def __call__(self, raws: list[bytes]):
        """(key of the word sequence, shingle hashes, bounds of each text's shingles). Fewer than k words are one shingle."""
        import numpy as np

        h, bounds = self.words(raws)
        counts, k = np.diff(bounds), self.k
        base, add = np.uint64(_scan.BASE), np.uint64(0x9FB21C651E98DF25)
        with np.errstate(over="ignore"):
            self.hasher.grow(len(h) + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((h + add) * self.hasher.powers[: len(h)])])
            keys = _scan.mix((sums[bounds[1:]] - sums[bounds[:-1]]) * self.hasher.inverse[np.minimum(bounds[:-1], len(h))] + counts.astype(np.uint64))
            windows = np.zeros(max(len(h) - k + 1, 0), np.uint64)
            for j in range(k):
                windows = windows * base + h[j : j + len(windows)]
            n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
            to = np.concatenate([[0], np.cumsum(n)])
            out = np.empty(to[-1], np.uint64)
            full = np.flatnonzero(counts >= k)
            spot = np.repeat(bounds[full] - to[full], n[full])
            mine = np.repeat(counts >= k, n)
            out[mine] = windows[np.flatnonzero(mine) + spot]
            for i in np.flatnonzero((counts > 0) & (counts < k)).tolist():
                acc = np.uint64(counts[i])
                for x in h[bounds[i] : bounds[i + 1]]:
                    acc = acc * base + x
                out[to[i]] = acc
            return keys, _scan.mix(out), to


def band_keys(shingles, bounds):
    """One hash a band of ROWS minima of each set of shingle hashes, for texts with shingles (the other rows are 0). Sets of
    similarity 0.8 share none of BANDS with probability 7e-5."""
    import numpy as np

    r = np.random.Generator(np.random.PCG64(SEED))
    mul, add = (r.integers(0, 1 << 32, BANDS * ROWS, np.uint32) for _ in range(2))
    weights = r.integers(0, 1 << 64, ROWS, np.uint64) | np.uint64(1)
    out, full = np.zeros((len(bounds) - 1, BANDS), np.uint64), np.flatnonzero(np.diff(bounds))
    if not len(full):
        return out
    least = np.full((BANDS * ROWS, len(full)), ~np.uint32(0))
    with np.errstate(over="ignore"):
        # parts of at most about 2**17 shingles; a text that is longer is a minimum over several parts
        step = 1 << 17
        high = (shingles >> np.uint64(32)).astype(np.uint32)
        for s in range(0, len(high), step):
            part, e = high[s : s + step], min(s + step, len(high))
            first, last = np.searchsorted(bounds[full + 1], s, "right"), np.searchsorted(bounds[full], e, "left")
            edges = np.maximum(bounds[full[first:last]] - s, 0)
            for i in range(BANDS * ROWS):
                least[i, first:last] = np.minimum(least[i, first:last], np.minimum.reduceat(part * (mul[i] | np.uint32(1)) + add[i], edges))
        low = least.reshape(BANDS, ROWS, -1).astype(np.uint64)
        acc = np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * np.uint64(_scan.BASE)
        for j in range(ROWS):
            acc = _scan.mix(acc + (low[:, j] + np.uint64(1)) * weights[j])
        out[full] = acc.T
    return out


def _sketch_batches(batches):
    import numpy as np
    import pyarrow as pa

    shingler, names = Shingler(), ["doc_id", "tk", "key", "full", "fp", *[f"b{i}" for i in range(BANDS)]]
    for b in _scan.slices(batches):
        raws = [r or b"" for r in b.column(2).cast(pa.binary()).to_pylist()]
        keys, shingles, bounds = shingler(raws)
        fps = np.fromiter((fingerprint(r) for r in raws), np.uint64, len(raws)).view(np.int64)
        bands = band_keys(shingles, bounds).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys.view(np.int64)), pa.array(np.diff(bounds) > 0), pa.array(fps), *[pa.array(bands[:, i]) for i in range(BANDS)]], names=names)


def _set_batches(batches):
    """The distinct shingle hashes of each text, in order."""
    import numpy as np
    import pyarrow as pa

    shingler = Shingler()
    for b in _scan.slices(batches):
        keys, shingles, bounds = shingler([r or b"" for r in b.column(0).cast(pa.binary()).to_pylist()])
        sets = [np.unique(shingles[s:e]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["key", "shingles"])


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs u, v of (rep, key) whose keys' shingle sets have a Jaccard similarity of SIMILARITY or more. Uses
    are counted once for both sides."""
    total = pairs.count()
    uses = pairs.select(F.explode(F.array("u.key", "v.key")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("uses"))
    uses = cluster.materialize(uses, "uses")
    dim = sets.join(cluster.small(uses, BROADCAST_KEYS), "key").select("key", "uses", "shingles")
    for side in ("u", "v"):
        pairs = cluster.lookup(pairs.withColumn("key", F.col(f"{side}.key")), dim, "key", "uses", total, F.col("v" if side == "u" else "u"))
        pairs = pairs.drop("key").withColumnRenamed("shingles", f"s{side}")
    both = F.size(F.array_intersect("su", "sv"))
    most, least = F.greatest(F.size("su"), F.size("sv")), F.least(F.size("su"), F.size("sv"))
    close = pairs.where(least >= SIMILARITY * most)
    return close.where(both >= SIMILARITY * (most + least - both)).select("u", "v")


def fingerprint_pairs(distinct: DataFrame) -> DataFrame:
    """Candidates u < v among the (rep, key) of distinct (key, rep, fp): the first of a fingerprint with its others and with the
    first of the fingerprints that links() names."""
    all = distinct.select("fp", F.struct("rep", "key").alias("v"))
    first = cluster.materialize(all.groupBy("fp").agg(F.min("v").alias("u"), F.count(F.lit(1)).alias("uses")), "prints")
    n, several = first.agg(F.count(F.lit(1)), F.count_if(F.col("uses") > 1)).first()
    shared = first.where("uses > 1")
    if several <= BROADCAST_NODES:
        own = all.join(F.broadcast(shared.select("fp", "u")), "fp")
    else:
        own = cluster.lookup(all, shared, "fp", "uses", distinct.count(), F.col("v"))
    near = cluster.materialize(links(first.select("fp"), n).select(F.col("u").alias("fu"), F.col("v").alias("fv")), "near")
    sent = F.broadcast if near.count() <= BROADCAST_NODES else lambda d: d
    near = first.select(F.col("fp").alias("fu"), F.col("u").alias("a")).join(sent(near), "fu")
    near = first.select(F.col("fp").alias("fv"), F.col("u").alias("b")).join(sent(near), "fv")
    return own.where("u < v").select("u", "v").unionByName(near.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))


def followers(labels: DataFrame) -> DataFrame:
    """The keys of labels that are not the first of their group."""
    return cluster.small(labels.where("label < node").select("node.key"), BROADCAST_KEYS)


def near_duplicates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and groups by Jaccard similarity of WORDS-word shingles. rows: doc_id, tk (hash of the text), key (hash of the
    words) and copies, one for each distinct (doc_id, tk). groups: key and label, one key of the group, for the keys that
    are similar to another one.

    Keys whose fingerprints are within RADIUS are candidates first, then those that share a band; each pair is checked by its
    sets. Of the groups that fingerprints give only the first key goes on to the bands. There, in each round the first keys of a band's
    cell (by least doc_id) are compared with all others in it and then leave the cell; of each group only the first key
    goes on, with four times as many leaders. Before each further round the keys that have too few shingles in common with
    all others together go, and pairs that could not have enough are not formed. Rounds end when no pair is left: then all
    pairs of the groups' first keys that share a band were compared or cannot be similar. So no two texts that stay are
    similar, and each that goes is similar to another one; a group that only later keys hold together may stay as several."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tk"), F.col("text").cast("string").alias("text"))
    bands = [f"b{i}" for i in range(BANDS)]
    sketches = cluster.materialize(_scan.over(texts, _sketch_batches, "doc_id long, tk long, key long, full boolean, fp long, " + ", ".join(f"{b} long" for b in bands)), "sketches")
    rows = cluster.materialize(sketches.groupBy("doc_id", "tk", "key").agg(F.count(F.lit(1)).alias("copies")), "identities")
    order = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    distinct = cluster.materialize(sketches.where("full").groupBy("key").agg(F.min(order).alias("rep"), F.min("fp").alias("fp"), *[F.min(b).alias(b) for b in bands]), "distinct")
    n_keys = distinct.count()
    cells = distinct.select("key", F.explode(F.array(*bands)).alias("cell"))
    shared = cluster.materialize(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("cell"), "shared")
    full = distinct.select("key", "rep", F.explode(F.array(*bands)).alias("cell"))
    cells = cluster.materialize(full.join(cluster.small(shared, BROADCAST_KEYS), "cell", "left_semi"), "cells")
    close = cluster.materialize(fingerprint_pairs(distinct.select("key", "rep", "fp")), "close")
    # one text of each key in a shared cell or with a candidate by fingerprints
    asked = cells.select("key").union(close.select("u.key")).union(close.select("v.key")).distinct()
    wanted = rows.groupBy("key").agg(F.min(F.struct("tk", "doc_id")).alias("one")).join(asked, "key", "left_semi")
    wanted = cluster.materialize(wanted.select(F.col("one.tk").alias("wtk"), F.col("one.doc_id").alias("wid")), "wanted")
    chosen = texts.join(cluster.small(wanted, BROADCAST_KEYS), (F.col("tk") == F.col("wtk")) & F.col("doc_id").eqNullSafe(F.col("wid")), "left_semi")
    sets = cluster.materialize(_scan.over(chosen.select("text"), _set_batches, "key long, shingles array<long>").dropDuplicates(["key"]), "sets")
    cluster.drop(sketches, shared, wanted)
    labels, leaders = None, 1
    alike = cluster.materialize(similar(close, sets), "alike")
    if alike.limit(1).count():
        labels = components(alike, n_keys)
        cells = cluster.materialize(cells.join(followers(labels), "key", "left_anti"), "cells")
    cluster.drop(close)
    cells = cells.select("cell", "key", F.struct("rep", "key").alias("o"), F.lit(0).alias("n"), F.lit(0).alias("m"))
    while True:
        sizes = cluster.materialize(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
        total, top = sizes.agg(F.sum("size"), F.max("size")).first()
        if not total:
            break
        first = cells.select("cell", "o", "n", "m", F.row_number().over(Window.partitionBy("cell").orderBy("o")).alias("r")).where(F.col("r") <= leaders)
        first = cluster.materialize(first.groupBy("cell").agg(F.collect_list(F.struct("o", "n", "m")).alias("first")).join(sizes, "cell"), "leaders")
        found = cluster.lookup(cells, first, "cell", "size", total, F.col("key"))
        fit = F.filter("first", lambda x: (x["o"] < F.col("o")) & ((F.col("n") == 0) | (F.least(F.col("m"), x["m"]) * (1 + SIMILARITY) >= SIMILARITY * (F.col("n") + x["n"]))))
        found = found.select("o", F.explode(fit).alias("l"))
        pairs = cluster.materialize(found.select(F.col("l.o").alias("u"), F.col("o").alias("v")).distinct(), "pairs")
        new = cluster.materialize(similar(pairs, sets), "similar")
        found = new.limit(1).count() > 0
        if found:
            # the groups so far are links of their first keys with the others
            edges = new if labels is None else new.unionByName(labels.where("label < node").select(F.col("label").alias("u"), F.col("node").alias("v")))
            labels = components(edges, n_keys)
        cluster.drop(pairs)
        if top <= leaders + 1:
            break
        # what goes on: the first key of each group, in the cells where it has led no comparison
        left = cells.select("cell", "key", "o")
        if found:
            left = left.join(followers(labels), "key", "left_anti")
        led = first.select("cell", F.explode("first.o.key").alias("key"))
        left = left.join(led, ["cell", "key"], "left_anti")
        left = cluster.materialize(left, "left")
        again = left.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("cell")
        left = left.join(again, "cell", "left_semi")
        asked = cluster.materialize(left.select("key").distinct(), "keys")
        left = cluster.materialize(left.join(shared_parts(cluster.small(asked, BROADCAST_KEYS), sets), "key").select("cell", "key", "o", "n", "m"), "cells")
        cluster.drop(cells, sizes, first)
        cells, leaders = left, leaders * 4
    cluster.drop(cells, sets)
    if labels is None:
        return rows, docs.sparkSession.createDataFrame([], "key long, label long")
    return rows, labels.select("node.key", F.col("label.key").alias("label"))


def shared_parts(keys: DataFrame, sets: DataFrame) -> DataFrame:
    """key, n (its shingles) and m (those that another of the keys has too), for the keys that can be similar to another
    one: two sets share at least SIMILARITY of the larger, so m is SIMILARITY * n at least."""
    own = sets.join(keys, "key", "left_semi").select("key", F.size("shingles").alias("n"), "shingles")
    # shingles of one key only, counted by key
    alone = own.select("key", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.min("key").alias("key"))
    alone = alone.where("df = 1").groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("alone"))
    met = own.select("key", "n").join(alone, "key", "left").select("key", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("m"))
    return met.where(F.col("m") >= SIMILARITY * F.col("n"))


def query(spark, sf_dir):
    found = close_fingerprints(cluster.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group the row with the smallest doc_id stays (then the least hash of its text); of rows equal
    in both, one. Decided on narrow rows; texts move only if more rows go than can be broadcast, and then once."""
    rows, groups = near_duplicates(docs)
    n = rows.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    if groups.count() <= BROADCAST_KEYS:
        label = rows.join(F.broadcast(groups), "key", "left")
    else:
        uses = rows.groupBy("key").agg(F.count(F.lit(1)).alias("uses"))
        label = cluster.lookup(rows, groups.join(uses, "key"), "key", "uses", n, F.col("tk"))
    label = cluster.materialize(label.select("doc_id", "tk", "copies", F.coalesce("label", "key").alias("label")), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")
    heads = label.groupBy("label").agg(F.min(order).alias("head"), F.count(F.lit(1)).alias("uses"))
    alike = cluster.materialize(heads.where("uses > 1"), "heads")
    if alike.count() <= BROADCAST_NODES:
        marked = label.join(F.broadcast(alike.select("label", "head")), "label", "left")
    else:
        marked = cluster.lookup(label, alike, "label", "uses", n, F.col("tk"))
    gone = F.coalesce(order != F.col("head"), F.lit(False))
    di, tk, state = cluster.fresh(docs.columns, "doc", "text_hash", "state")
    marked = marked.select(F.col("doc_id").alias(di), F.col("tk").alias(tk), F.when(gone, 1).when(F.col("copies") > 1, 2).alias(state)).where(F.col(state).isNotNull())
    marked = cluster.materialize(marked, "decisions")
    repeated = marked.where(F.col(state) == 2).limit(1).count()
    same = (F.xxhash64(docs["text"].cast("string")) == F.col(tk)) & docs["doc_id"].cast("long").eqNullSafe(F.col(di))
    joined = docs.join(cluster.small(marked, BROADCAST_KEYS), same, "left")
    out = joined.where(F.col(state).isNull()).select(*docs.columns)
    if repeated:
        twice = joined.where(F.col(state) == 2).groupBy(di, tk).agg(F.first(F.struct(*docs.columns)).alias(state))
        out = out.unionByName(twice.select(f"{state}.*"))
    return out
