"""Personal data, and terms that give it away.

Spans of e-mail addresses, IP addresses, card and phone numbers are found by pattern. So are assigned secrets (token = "..."),
by what they tell: a value of SECRET_BITS bits or more, its length times the entropy of its characters. The values of all
these spans, and the hosts of e-mail addresses, are the protected entities.

For each entity e and each term t within NEAR words of it, the corpus gives document frequencies: p(e), p(t) and p(e, t).
What t tells of e is the pointwise mutual information ln p(e, t) / (p(e) p(t)); what there is to tell is the information
content -ln p(e). A term whose share PMI / IC is REMOVE or more is removed wherever it stands in a text with e; from
GENERALISE on it is generalised to a placeholder of its kind. A pair counts only if it was seen in SUPPORT documents and in
SUPPORT different surroundings, so a copied passage or a single rare word is no evidence.

A term is a run of TERM or more letters of any script, in lower case, on both sides. Pairs and frequencies are counted over
all documents; frequencies are needed of the terms of frequent pairs only, so without such a pair they are not counted. The
entities of each document are joined with the flagged pairs, and documents with flagged terms are searched as a whole.

Defined cases: null and empty texts have no spans; repeated rows get equal results (and count each in the frequencies);
a null doc_id is kept; an empty table gives an empty result; texts of any length are read whole; extra columns are not read
by the query and kept by the stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline import cluster
from loomline.llm import _scan

cluster.ship_by_value(__name__)

KINDS = ["email", "ip", "card", "phone"]
#: Words on each side of an entity, and the least length of a term.
NEAR, TERM = 8, 4
#: Characters without white space that are one word.
LONG = 64
SUPPORT, GENERALISE, REMOVE = 3, 0.7, 0.9
#: Least characters and bits of an assigned secret.
SECRET_LENGTH, SECRET_BITS = 16, 60
#: Documents with flagged terms are broadcast up to this number, and terms whose frequencies are counted up to that one.
BROADCAST_ROWS, BROADCAST_TERMS = 50_000, 500_000
#: Entities or pairs of a document in one row of the table between.
PART = 4096


class Finder:
    def __init__(self):
        import re

        self.domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
        self.local = re.compile(r"[A-Za-z0-9._%+-]+\Z")
        self.local_char = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
        self.ip = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
        self.card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
        self.phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
        self.term = re.compile(r"[^\W\d_]{%d,}" % TERM)
        self.word = re.compile(r"[^\x20\x09-\x0D]+")
        self.run = re.compile(r"[^\W_]+")
        self.secret = re.compile(r"[=:]\s*[\"']?([A-Za-z0-9+_-][A-Za-z0-9+/_=-]{%d,})" % (SECRET_LENGTH - 1))

    def emails(self, t: str):
        """As the pattern finds them, from each @ outwards: its runs before and after do not hold another."""
        at, free = t.find("@"), 0
        while at >= 0:
            s = at
            while s > free and t[s - 1] in self.local_char:
                s -= 1
            if s < at and (m := self.domain.match(t, at + 1)):
                yield s, m.end()
                free = m.end()
            at = t.find("@", max(at + 1, free))

    def spans(self, t: str) -> list[tuple[str, int, int]]:
        out = [("email", *x) for x in self.emails(t)]
        if "." in t:
            out += [("ip", *m.span()) for m in self.ip.finditer(t) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
        for m in self.card.finditer(t):
            if m.end() - m.start() >= 16:
                d = [int(c) for c in m[0] if c.isdigit()]
                if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0:
                    out.append(("card", *m.span()))
        if "+" in t:
            out += [("phone", *m.span()) for m in self.phone.finditer(t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
        return out

    def secrets(self, t: str) -> list[tuple[str, int, int]]:
        """Assigned values that have letters, digits and SECRET_BITS bits at least."""
        import math
        from collections import Counter

        out = []
        for m in self.secret.finditer(t) if "=" in t or ":" in t else ():
            v = m[1]
            bits = -sum(n * math.log2(n / len(v)) for n in Counter(v).values())
            before = t[max(0, m.start() - 100) : m.start()].rstrip()[-1:]
            if bits >= SECRET_BITS and before.isalnum() and any(c.isdigit() for c in v) and any(c.isalpha() for c in v):
                out.append(("secret", *m.span(1)))
        return out

    def entities(self, t: str, span) -> list[str]:
        kind, s, e = span
        v = t[s:e].lower()
        return [f"{kind}:{v}", f"host:{v.rsplit('@', 1)[1]}"] if kind == "email" else [f"{kind}:{v}"]

    def terms(self, t: str, spans):
        """Matches of all terms that stand outside all spans."""
        taken, at = [], 0
        for s, e in sorted((s, e) for _, s, e in spans):
            if taken and s < taken[-1][1]:
                taken[-1] = taken[-1][0], max(e, taken[-1][1])
            else:
                taken.append((s, e))
        for m in self.term.finditer(t):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if not (at < len(taken) and taken[at][0] < m.end()):
                yield m

    def near(self, t: str, spans):
        """For each span: the span, the terms within NEAR words on each side, and these words. Words are cut at the span. What
        stands without white space for more than LONG characters is as many words as it has runs of letters and digits, so
        that no word, and no span's surroundings, is a whole text of lists or tables."""
        from bisect import bisect_left, bisect_right

        words = []
        for s, e in (m.span() for m in self.word.finditer(t)):
            if e - s <= LONG:
                words.append((s, e))
            else:
                words += [m.span() for m in self.run.finditer(t, s, e)]
        starts, ends = [s for s, _ in words], [e for _, e in words]
        terms = [(m.start(), m.end(), m[0].lower()) for m in self.terms(t, spans)]
        at = [s for s, _, _ in terms]
        for span in spans:
            _, s, e = span
            left, right = bisect_left(starts, s), bisect_right(ends, e)
            lo = starts[max(0, left - NEAR)] if left else s
            hi = ends[min(len(ends), right + NEAR) - 1] if right < len(ends) else e
            lo, hi = min(lo, s), max(hi, e)
            own = {w for _, z, w in terms[bisect_left(at, lo) : bisect_left(at, hi)] if z <= hi}
            yield span, own, t[lo:s] + "\0" + t[e:hi]

    def places(self, t: str, spans, actions: dict[str, str]):
        """(action, start, end) of all terms in actions that stand outside all spans."""
        for m in self.terms(t, spans):
            if m[0].lower() in actions:
                yield actions[m[0].lower()], *m.span()


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


BASE = "doc_id long, key long, part int, n_email long, n_ip long, n_card long, n_phone long, base string, secrets string, entities array<string>, near array<struct<entity:string,term:string,thash:long,around:long,lead:int>>"


def _base_batches(batches):
    """A row for each text (part 0), and more where it has many entities or pairs."""
    import pyarrow as pa
    import xxhash

    find, hashes, near_type = Finder(), {}, pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("thash", pa.int64()), ("around", pa.int64()), ("lead", pa.int32())]))
    types = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.string(), pa.list_(pa.string()), near_type]
    names = ["doc_id", "key", "part", "n_email", "n_ip", "n_card", "n_phone", "base", "secrets", "entities", "near"]
    for b in _scan.slices(batches):
        rows = []
        hashes.clear()
        for doc_id, key, t in zip(*(c.to_pylist() for c in b.columns)):
            spans, secrets = (find.spans(t), find.secrets(t)) if t else ([], [])
            every, entities, near, led = spans + secrets, set(), set(), set()
            if every:
                for span, terms, words in find.near(t, every):
                    around = xxhash.xxh64_intdigest(words.encode("utf-8", "surrogatepass")) >> 1
                    for e in find.entities(t, span):
                        entities.add(e)
                        near |= {(e, w, around) for w in terms}
            pairs = []
            for e, w, around in sorted(near):
                if w not in hashes:
                    hashes[w] = _scan.word_hash(w.encode())
                pairs.append({"entity": e, "term": w, "thash": hashes[w], "around": around, "lead": int((e, w) not in led)})
                led.add((e, w))
            entities = sorted(entities)
            counts = [sum(x[0] == k for x in spans) for k in KINDS]
            rows.append((doc_id, key, 0, *counts, joined(spans), joined(secrets), entities[:PART], pairs[:PART]))
            for i in range(1, -(-max(len(entities), len(pairs)) // PART)):
                rows.append((doc_id, key, i, 0, 0, 0, 0, "", "", entities[i * PART : (i + 1) * PART], pairs[i * PART : (i + 1) * PART]))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names=names)


def _frequency_batches(batches, wanted=None):
    """Partial document frequencies of the terms of a partition, by hash: of those in wanted (sorted hashes), or of all.
    ASCII texts are scanned as bytes, where runs of letters are the terms; others by the pattern of Finder and its lower
    case."""
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    hasher, cls, own, term, words = _scan.Hasher(), _scan.byte_classes(), [], Finder().term, Counter()

    def only(h):
        return h if wanted is None or not len(h) else h[wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h]

    def merged(parts):
        keys, inv = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(inv, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    def counted():
        raws = [w.encode() for w in words]
        ends = np.cumsum([len(r) + 1 for r in raws]) - 1
        h = hasher.spans(np.frombuffer(b"\n".join(raws), np.uint8), np.concatenate([[0], ends[:-1] + 1]), ends)
        return merged([(h, np.fromiter(words.values(), np.int64, len(words)))])

    for b in _scan.slices(batches):
        raws = [r for r in b.column(0).cast(pa.binary()).to_pylist() if r]
        for r in raws:
            if not r.isascii():
                words.update({w.lower() for w in set(term.findall(r.decode("utf-8", "replace")))})
            if len(words) >= 100_000:
                own.append(counted())
                words.clear()
        raws = [r for r in raws if r.isascii()]
        for at in _scan.groups(raws):
            buf = np.frombuffer(b"\n".join(raws[i] for i in at), np.uint8)
            starts, ends, _ = _scan.runs(cls[buf], [_scan.LETTER])
            starts, ends = (x[ends - starts >= TERM] for x in (starts, ends))
            if not len(starts):
                continue
            h = hasher.spans(_scan.lower(buf), starts, ends)
            doc = np.searchsorted(np.cumsum([len(raws[i]) + 1 for i in at]), starts, "right").astype(np.uint64)
            with np.errstate(over="ignore"):
                _, first = np.unique(h * np.uint64(0x9E3779B97F4A7C15) + doc * np.uint64(0xD1342543DE82EF95), return_index=True)
            own.append(np.unique(only(h[first]), return_counts=True))
            if len(own) >= 8:
                own = [merged(own)]
    if words:
        own.append(counted())
    if own:
        keys, n = merged(own)
        if wanted is not None:
            n, keys = n[np.isin(keys, wanted)], keys[np.isin(keys, wanted)]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["thash", "df"])


def frequent_pairs(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the table of BASE: entities (entity, ce) in SUPPORT documents or more, and their pairs (entity, term, thash, both)
    with SUPPORT documents and surroundings or more."""
    entities = base.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("ce")).where(F.col("ce") >= SUPPORT)
    entities = cluster.materialize(entities, "entities")
    near = base.select(F.explode("near").alias("x")).select("x.*").join(cluster.small(entities.select("entity"), BROADCAST_ROWS), "entity", "left_semi")
    places = near.groupBy("entity", "term", "thash", "around").agg(F.sum("lead").alias("n"))
    pairs = places.groupBy("entity", "term", "thash").agg(F.sum("n").alias("both"), F.count(F.lit(1)).alias("seen"))
    return entities, cluster.materialize(pairs.where(F.least("both", "seen") >= SUPPORT).drop("seen"), "pairs")


def disclosing(entities: DataFrame, pairs: DataFrame, frequencies: DataFrame, total: int) -> DataFrame:
    """entity, ce, term and action ('generalise' or 'remove') of the pairs over the thresholds. frequencies: thash and df."""
    ct = frequencies.join(pairs.select("thash").distinct(), "thash", "left_semi").groupBy("thash").agg(F.sum("df").alias("ct"))
    own = pairs.join(ct, "thash").join(entities, "entity")
    n = F.lit(float(max(total, 2)))
    share = F.log(n * F.col("both") / (F.col("ce") * F.greatest("ct", "both"))) / F.log(n / F.least(F.col("ce").cast("double"), n - 1))
    own = own.withColumn("share", share).where(F.col("share") >= GENERALISE)
    return own.select("entity", "ce", "term", F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise").alias("action"))


def _place_batches(batches):
    import pyarrow as pa

    find = Finder()
    for b in _scan.slices(batches):
        more = [joined(find.places(t, find.spans(t) + find.secrets(t), {x["term"]: x["action"] for x in terms})) for t, terms in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(more, pa.string())], names=["__d", "__k", "more"])


def flagged_terms(docs: DataFrame, base: DataFrame) -> DataFrame | None:
    """doc_id, key and terms (term, action) of the rows that hold entities with disclosing terms; None if no pair is
    frequent."""
    spark = docs.sparkSession
    entities, pairs = frequent_pairs(base)
    hashes = pairs.select("thash").distinct()
    n = hashes.count()
    if not n:
        return None
    wanted = None
    if n <= BROADCAST_TERMS:
        import numpy as np

        wanted = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in hashes.collect()], np.int64).view(np.uint64)))

    def run(batches):
        return _frequency_batches(batches, wanted.value if wanted else None)

    counted = _scan.over(docs.select(F.col("text").cast("string")), run, "thash long, df long").groupBy("thash").agg(F.sum("df").alias("df"))
    flagged = disclosing(entities, pairs, counted, base.where("part = 0").count())
    flagged = cluster.materialize(flagged.groupBy("entity", "ce").agg(F.collect_list(F.struct("term", "action")).alias("terms")), "flagged")
    held = base.select("doc_id", "key", F.explode("entities").alias("entity"))
    found = cluster.lookup(held, flagged, "entity", "ce", held.count(), F.struct("doc_id", "key")).where("terms is not null")
    # a term of two entities has its strongest action
    terms = found.select("doc_id", "key", F.explode("terms").alias("x")).groupBy("doc_id", "key", "x.term").agg(F.max("x.action").alias("action"))
    return terms.groupBy("doc_id", "key").agg(F.collect_list(F.struct("term", "action")).alias("terms"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), counts by kind, base, secrets and more: base spans, secrets and flagged terms, each
    as text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))
    base = cluster.materialize(_scan.over(rows, _base_batches, BASE), "base")
    texts, columns = base.where("part = 0"), ["doc_id", "key", "n_email", "n_ip", "n_card", "n_phone", "base", "secrets"]
    terms = flagged_terms(docs, base)
    if terms is None:
        return texts.select(*columns, F.lit("").alias("more"))
    terms = cluster.materialize(terms.select(F.col("doc_id").alias("__d"), F.col("key").alias("__k"), "terms"), "terms")
    on = (F.col("key") == F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__d"))
    held = rows.join(cluster.small(terms, BROADCAST_ROWS), on).select("__d", "__k", "text", "terms")
    more = cluster.materialize(_scan.over(held, _place_batches, "__d long, __k long, more string").where("more <> ''").distinct(), "more")
    return texts.join(cluster.small(more, BROADCAST_ROWS), on, "left").select(*columns, F.coalesce("more", F.lit("")).alias("more"))


def query(spark, sf_dir):
    found = find(cluster.table(spark, sf_dir, "documents"))
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    count = lambda c: F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, ","))).cast("long")
    own = found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), F.concat_ws(",", filled("base"), filled("secrets"), filled("more")).alias("spans"), count("secrets").alias("n_secret"), count("more").alias("n_term"))
    return own.withColumn("n_spans", count("spans"))


def redact(text: str, spans: str) -> str:
    """Replace spans by [EMAIL], [IP], [CARD], [PHONE], [SECRET], [NAME] or [TERM]; removed terms leave nothing."""
    cut = sorted((int(s), -int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x))
    out, at = [], 0
    for s, e, kind in cut:
        if s >= at:
            new = "" if kind == "remove" else f"[{kind.upper()}]" if kind in (*KINDS, "secret") else "[NAME]" if text[s].isupper() else "[TERM]"
            out += [text[at:s], new]
            at = -e
        elif -e > at:  # the end of an overlapping span goes too
            at = -e
    return "".join(out) + text[at:]


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without personal data, secrets and the terms that disclose them; every document stays. Spans are
    found again in the scan that replaces them; the few documents with flagged terms are joined."""
    di, tk, extra = cluster.fresh(docs.columns, "doc", "text_hash", "more")
    more = find(docs).where("more <> ''").select(F.col("doc_id").alias(di), F.col("key").alias(tk), F.col("more").alias(extra)).distinct()
    more = cluster.materialize(more, "flagged")
    same = (F.xxhash64(docs["text"].cast("string")) == F.col(tk)) & docs["doc_id"].cast("long").eqNullSafe(F.col(di))
    rows = docs.join(cluster.small(more, BROADCAST_ROWS), same, "left").select(*docs.columns, extra)
    names, n = list(docs.columns), len(docs.columns)
    at = names.index("text")

    def run(batches):
        import pyarrow as pa

        find = Finder()
        for b in _scan.slices(batches):
            texts = []
            for t, further in zip(b.column(at).to_pylist(), b.column(n).to_pylist()):
                own = joined(find.spans(t) + find.secrets(t)) if t else ""
                texts.append(redact(t, f"{own},{further or ''}") if own or further else t)
            cols = [pa.array(texts, b.column(i).type) if i == at else b.column(i) for i in range(n)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return _scan.over(rows, run, docs.schema)
