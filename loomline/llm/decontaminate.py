"""Benchmark decontamination by template canonicalisation.

Tokens are words and numbers, and single characters of scripts without spaces. A number with its separators is one token, and
so is a number in words. In a template, numbers become <number>, units after a number <unit>, and names <name>; all other
words stay, in lower case. What is a name cannot be told for sure, so a window of WINDOW tokens has up to three templates:
words with a capital inside a sentence are names (1), no word is a name (2), and words that begin a sentence with a capital
are names too (3). A window with fewer than LITERALS literal words in its second template is also kept as it is, numbers and
all (4). Windows of documents are looked up in all four forms; so a copy is found whatever its names, numbers and case, and an
item of numbers only is found where it stands as it is.

Matches of an item in one stretch of a document are judged together. Each value in the item's slots stands for one value in
the document's, the one that it meets most often, and the other way round; windows with other values do not count. Of
values that meet equally often, the one that stands first in the item's matched part counts, then the one that the document
has first; of stretches with equally many windows, the first. A document is contaminated by an item if at least SHARE of the item's windows, or RUN of them, are found with consistent slots;
so a question with other numbers and names is caught, and a passage that shares only its frame with conflicting values is not.

Items shorter than WINDOW tokens are one window of their own length; items of one or two tokens contaminate only documents of
just these tokens. A copy in lower case whose names were changed as well is found only by its windows without names.

The benchmark's windows are sent to all executors; they come in blocks of BLOCK bytes of text, one scan of the documents a
block, so a benchmark of any size is handled. Documents are matched many at a time. Windows that many items share are a
group: a document counts a group's rows once, however often it has the window, and only items with as many rows as they need
windows are looked at; of these, items whose matched parts have the same slots, with the same ones equal, are judged once. So
a benchmark made from one template costs a few array operations an item.

Defined cases: null and empty texts and texts without tokens match nothing, nor do such items; items with equal text match
alike; repeated rows are judged each; empty tables give empty results; texts of any length are read whole (over 2 MiB in pieces
that end at white space); extra columns are not read by the query and kept by the stage. The stage keeps null and empty texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline import cluster
from loomline.llm import _scan

cluster.ship_by_value(__name__)

WINDOW, LITERALS, SHARE, RUN = 8, 4, 0.5, 40
BLOCK = 16 << 20
#: Rows of windows and items that are laid out at a time.
EXPAND = 1 << 20
UNITS = ["kg", "g", "mg", "lb", "lbs", "oz", "km", "m", "cm", "mm", "mi", "miles", "ft", "feet", "inch", "inches", "l", "ml", "liters", "litres",
         "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks", "months", "years", "dollars", "euros", "cents", "percent",
         "km/h", "mph", "kw", "w", "v", "hz", "gb", "mb", "degrees"]
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen",
                "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred",
                "thousand", "million", "billion", "dozen"]
LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3


class Tokens:
    """Token arrays of many texts: text number, hash in lower case, slot type, whether a sentence begins there."""

    def __init__(self):
        import numpy as np

        own = lambda words: np.sort(np.array([_scan.word_hash(w.encode()) for w in words], np.int64).view(np.uint64))
        self.hasher, self.cls, self.units, self.numbers = _scan.Hasher(), _scan.byte_classes(), own(UNITS), own(NUMBER_WORDS)
        self.stops = np.zeros(256, bool)
        self.stops[list(b".!?\n:;|\"")] = True

    def __call__(self, raws: list[bytes]):
        import numpy as np

        made = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, bool))]
        for group in _scan.groups(raws):
            if len(group) == 1 and len(raws[group[0]]) > 1 << 21:
                raw, at = raws[group[0]], 0
                while at < len(raw):  # very long texts in pieces that end at white space
                    end = min(len(raw), at + (1 << 20))
                    while end < len(raw) and self.cls[raw[end]] != _scan.SPACE:
                        end += 1
                    made.append(self._of([raw[at:end]], group))
                    at = end
            else:
                made.append(self._of([raws[i] for i in group], group))
        return [np.concatenate(x) for x in zip(*made)]

    def _of(self, raws, numbers):
        import numpy as np

        buf = np.frombuffer(b"\n".join(raws), np.uint8)
        cls = self.cls[buf]
        if len(buf) > 2:  # separators inside a number
            cls[1:-1][((buf[1:-1] == 46) | (buf[1:-1] == 44)) & (cls[:-2] == _scan.DIGIT) & (cls[2:] == _scan.DIGIT)] = _scan.DIGIT
        begins = np.zeros(len(buf), bool)
        if len(buf) and buf.max() >= 0xE0:  # characters that are tokens of their own: Han, kana, Thai and Lao
            following = np.append(buf[1:], 0)
            lead = np.flatnonzero((buf >= 0xE3) & (buf <= 0xE9) | (buf == 0xE0) & (following >= 0xB8) & (following <= 0xBB))
            mark = (buf[lead] == 0xE3) & (following[lead] == 0x80)
            for k in range(3):
                at = np.minimum(lead + k, len(buf) - 1)
                cls[at] = np.where(mark, _scan.OTHER, 9)
            begins[lead] = True
        if not len(buf):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, bool)
        at = np.flatnonzero(np.concatenate([[True], (cls[1:] != cls[:-1]) | begins[1:]]))
        ends, kind = np.append(at[1:], len(buf)), cls[at]
        keep = (kind == _scan.LETTER) | (kind == _scan.DIGIT) | (kind == 9)
        starts, ends, kind = at[keep], ends[keep], kind[keep]
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, bool)
        h = self.hasher.spans(_scan.lower(buf), starts, ends)
        stop = np.concatenate([[0], np.cumsum(self.stops[buf])])
        first = np.ones(len(starts), bool)  # a sentence ends between the token before and this one
        first[1:] = stop[starts[1:]] > stop[ends[:-1]]
        padded = np.concatenate([buf, np.zeros(4, np.uint8)])

        def upper(i):
            return (padded[i] >= 65) & (padded[i] <= 90) | (padded[i] == 0xC3) & (padded[i + 1] >= 0x80) & (padded[i + 1] <= 0x9E)

        second = starts + np.where(buf[starts] >= 0xC0, 2, 1)
        name = (kind == _scan.LETTER) & upper(starts) & (second < ends) & ~upper(second)  # not single letters, nor words in capitals
        word = np.isin(h, self.numbers)
        number = (kind == _scan.DIGIT) | word
        slot = np.where(number, NUMBER, np.where(name, NAME, LITERAL)).astype(np.uint8)
        after = np.concatenate([[False], number[:-1]]) & ~first
        slot[after & np.isin(h, self.units)] = UNIT
        # number words in a row are one number
        gap = buf[np.minimum(ends[:-1], len(buf) - 1)]
        more = np.concatenate([[False], word[1:] & word[:-1] & (starts[1:] - ends[:-1] == 1) & ((gap == 32) | (gap == 45))])
        heads = np.flatnonzero(~more)
        with np.errstate(over="ignore"):
            h = np.add.reduceat(h, heads)
        edges = np.cumsum([len(r) + 1 for r in raws])
        return np.array(numbers, np.int64)[np.searchsorted(edges, starts[heads], "right")], h, slot[heads], first[heads]


class Windows:
    """Hashes of all windows of w tokens in the four forms."""

    def __init__(self, text, h, slot, first):
        import numpy as np

        self.text, self.h, self.slot, self.n = text, h, slot, len(h)
        marks = np.array([0, 11, 22, 33], np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F % (1 << 58))
        name = slot == NAME
        slotted = np.where((slot == NUMBER) | (slot == UNIT), marks[slot], h)
        self.forms = [np.where(name & ~first, marks[NAME], slotted), slotted, np.where(name, marks[NAME], slotted), h]
        self.sums = None

    def of(self, w: int, hasher):
        """(starts of the windows within one text, [hashes by form])."""
        import numpy as np

        hasher.grow(self.n + 1)
        with np.errstate(over="ignore"):
            if self.sums is None:
                self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum((x + np.uint64(1)) * hasher.powers[: self.n])]) for x in self.forms]
            n = max(self.n - w + 1, 0)
            at = np.flatnonzero(self.text[:n] == self.text[w - 1 : w - 1 + n])
            return at, [_scan.mix((s[at + w] - s[at]) * hasher.inverse[at] + np.uint64(w)) for s in self.sums]


def index(items: list[tuple[int, bytes]]) -> dict:
    """Windows of benchmark items. Windows with the same hash are a group; a group has a range of (item, position) rows.
    tables: by width, the sorted hashes and the number of the first one's group."""
    import numpy as np

    tokens, meta, found = Tokens(), [], {}
    for i, (item_id, raw) in enumerate(items):
        text, h, slot, first = tokens([raw])
        w = min(WINDOW, len(h))
        n = max(len(h) - w + 1, 0) if w else 0
        meta.append((item_id, n, len(h), slot, h, w))
        if not n:
            continue
        at, forms = Windows(text, h, slot, first).of(w, tokens.hasher)
        enough = min(LITERALS, w - 1)
        literal = lambda named: np.diff(np.concatenate([[0], np.cumsum((slot == LITERAL) | (slot == NAME) & ~named)])[np.stack([at, at + w])], axis=0)[0]
        plain = literal(np.zeros(len(h), bool))
        for form, some in zip(forms, (literal(~first), plain, literal(np.ones(len(h), bool)), None)):
            ok = np.flatnonzero((plain < enough) if some is None else (some >= enough)) if w > 2 else at if some is None else at[:0]
            found.setdefault(w, []).append((form[ok], np.full(len(ok), i), ok))
    tables, starts, item, pos = {}, [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    n_groups = n_rows = 0
    for w, parts in found.items():
        rows = np.stack([np.concatenate([p[k].astype(np.uint64) for p in parts]) for k in range(3)], axis=1)
        rows = np.unique(rows, axis=0)  # by hash, item and position
        hashes, at = np.unique(rows[:, 0], return_index=True)
        tables[w] = hashes, n_groups
        starts.append(at + n_rows)
        item.append(rows[:, 1].astype(np.int64))
        pos.append(rows[:, 2].astype(np.int64))
        n_groups, n_rows = n_groups + len(hashes), n_rows + len(rows)
    need = [max(1, int(np.ceil(min(SHARE * m[1], RUN)))) if m[1] else 1 << 60 for m in meta]
    return {"tables": tables, "starts": np.concatenate([*starts, [n_rows]]).astype(np.int64), "item": np.concatenate(item), "pos": np.concatenate(pos), "meta": meta, "need": np.array(need, np.int64)}


def spread(starts, n):
    """Indices starts[i], starts[i] + 1, ... of n[i] each, one after the other."""
    import numpy as np

    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())


class Matcher:
    def __init__(self, bench: dict):
        import numpy as np

        self.tokens, self.b = Tokens(), bench
        self.filters = {}
        for w, (hashes, _) in bench["tables"].items():  # most windows miss here
            self.filters[w] = np.zeros(1 << 20, bool)
            self.filters[w][(hashes >> np.uint64(44)).astype(np.int64)] = True
        self.sizes = np.diff(bench["starts"])

    def match(self, raws: list[bytes]):
        """For each text, (item index, windows found, item's windows, slots with another value) of each item that
        contaminates it, by item."""
        import numpy as np

        out = [[] for _ in raws]
        text, h, slot, first = self.tokens(raws)
        windows = Windows(text, h, slot, first)
        sizes = np.bincount(text, minlength=len(raws)) if len(text) else np.zeros(len(raws), np.int64)
        hits = []
        for w, (hashes, base) in self.b["tables"].items():
            at, forms = windows.of(w, self.tokens.hasher)
            for got in forms:
                some = np.flatnonzero(self.filters[w][(got >> np.uint64(44)).astype(np.int64)])
                if w < 3:  # only a text of just these tokens
                    some = some[sizes[text[at[some]]] == w]
                g = np.minimum(np.searchsorted(hashes, got[some]), len(hashes) - 1)
                same = hashes[g] == got[some]
                hits.append(np.stack([at[some[same]], g[same] + base], axis=1))
        hits = np.unique(np.concatenate(hits), axis=0) if hits else np.zeros((0, 2), np.int64)
        if not len(hits):
            return out
        of = text[hits[:, 0]]  # rising
        for t, items in self.possible(of, hits[:, 1]):
            a, b = np.searchsorted(of, [t, t + 1])
            out[t] = self.contained(hits[a:b, 0], hits[a:b, 1], items, h)
        return out

    def possible(self, text, group):
        """(text, items) of the items with as many rows in the groups that a text hits as they need windows, so that the
        others cannot be found. A group counts once a text, however often the text has its window."""
        import numpy as np

        n_items, pairs = len(self.b["meta"]), np.unique(np.stack([text, group], axis=1), axis=0)
        text, group = pairs[:, 0], pairs[:, 1]
        n, ends = self.sizes[group], np.append(np.flatnonzero(np.diff(text)) + 1, len(text))
        upto, s = np.cumsum(n), 0
        while s < len(text):
            # as many texts as have EXPAND rows, or one
            e = int(ends[max(np.searchsorted(ends, s, "right"), np.searchsorted(upto[ends - 1], upto[s] - n[s] + EXPAND, "right") - 1)])
            if n[s:e].sum() <= EXPAND:
                item = self.b["item"][spread(self.b["starts"][group[s:e]], n[s:e])]
                owner, count = np.unique(np.repeat(text[s:e], n[s:e]) * n_items + item, return_counts=True)
                owner = owner[count >= self.b["need"][owner % n_items]]
                yield from ((int(t), owner[owner // n_items == t] % n_items) for t in np.unique(owner // n_items))
            else:
                count, k = np.zeros(n_items, np.int64), s
                while k < e:
                    z = min(e, max(k + 1, int(np.searchsorted(upto, upto[k] - n[k] + EXPAND, "right"))))
                    count += np.bincount(self.b["item"][spread(self.b["starts"][group[k:z]], n[k:z])], minlength=n_items)
                    k = z
                if len(items := np.flatnonzero(count >= self.b["need"])):
                    yield int(text[s]), items
            s = e

    def contained(self, p, g, items, h):
        """The items, of those that are possible, that a text contaminates. p, g: its windows' places and groups."""
        import numpy as np

        wanted = np.zeros(len(self.b["meta"]), bool)
        wanted[items] = True
        order = np.argsort(g, kind="stable")
        p, groups, begin, n_at = p[order], *np.unique(g[order], return_index=True, return_counts=True)
        rows = []
        for k in range(0, len(groups), 256):  # rows of possible items only
            own = groups[k : k + 256]
            at = spread(self.b["starts"][own], self.sizes[own])
            of = np.repeat(np.arange(k, k + len(own)), self.sizes[own])
            keep = wanted[self.b["item"][at]]
            rows.append(np.stack([self.b["item"][at[keep]], self.b["pos"][at[keep]], of[keep]], axis=1))
        rows = np.concatenate(rows)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        n, ends = n_at[rows[:, 2]], np.append(np.flatnonzero(np.diff(rows[:, 0])) + 1, len(rows))
        upto, s, found, memo = np.cumsum(n), 0, [], {}
        while s < len(rows):
            e = int(ends[max(np.searchsorted(ends, s, "right"), np.searchsorted(upto[ends - 1], upto[s] - n[s] + EXPAND, "right") - 1)])
            own = rows[s:e]
            pairs = np.stack([np.repeat(own[:, 0], n[s:e]), p[spread(begin[own[:, 2]], n[s:e])], np.repeat(own[:, 1], n[s:e])], axis=1)
            pairs = pairs[np.lexsort((pairs[:, 2], pairs[:, 1], pairs[:, 0]))]
            pairs = pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)])]
            for part in np.split(pairs, np.flatnonzero(np.diff(pairs[:, 0])) + 1):
                if got := self.judge(int(part[0, 0]), part[:, 1], part[:, 2], h, memo):
                    found.append(got)
            s = e
        return found

    def judge(self, item: int, p, q, h, memo: dict):
        """The best stretch of matches (document position p, item position q, sorted by p), or None. Items whose matched
        tokens have the same slots, equal where theirs are equal, are judged once."""
        import numpy as np

        _, n_windows, length, slot, own, w = self.b["meta"][item]
        need, a, b = int(self.b["need"][item]), int(q.min()), int(q.max()) + w
        _, at, which = np.unique(np.stack([slot[a:b].astype(np.uint64), own[a:b]]), axis=1, return_index=True, return_inverse=True)
        symbol = np.where(slot[a:b] > 0, at[which.reshape(-1)], -1)
        key = need, length, w, p.tobytes(), (q - a).tobytes(), slot[a:b].tobytes(), symbol.tobytes()
        if key not in memo:
            cuts, best = np.flatnonzero(np.diff(p) > length) + 1, None
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(p)]):
                got = self.stretch(need, w, slot[a:b], symbol, p[x:y].tolist(), (q[x:y] - a).tolist(), h)
                if got and (best is None or got[0] > best[0]):
                    best = got
            memo[key] = best
        if (best := memo[key]) is None:
            return None
        used, values = best
        return item, used, n_windows, sum(int(own[a + v]) != d for v, d in values)

    def stretch(self, need: int, w: int, slot, symbol, p, q, h):
        """(windows found, (slot, the document's value) of each value in them) with consistent slots, or None if too few."""
        from collections import Counter

        if len(set(q)) < need:
            return None
        met = sorted({(y + k, x + k) for x, y in zip(p, q) for k in range(w) if slot[y + k]})
        votes, seen = Counter(), {}
        for y, x in met:
            votes[int(slot[y]), int(symbol[y]), int(h[x])] += 1
            seen[int(slot[y]), int(h[x])] = min(x, seen.get((int(slot[y]), int(h[x])), x))
        there, back = {}, {}
        # a symbol is the first slot that has its value
        for (kind, v, d), _ in sorted(votes.items(), key=lambda e: (-e[1], e[0][1], seen[e[0][0], e[0][2]])):
            there.setdefault((kind, v), d)
            back.setdefault((kind, d), v)
        fits = {(x, y): there[int(slot[y]), int(symbol[y])] == int(h[x]) and back[int(slot[y]), int(h[x])] == int(symbol[y]) for y, x in met}
        used = {y for x, y in zip(p, q) if all(fits.get((x + k, y + k), True) for k in range(w))}
        if len(used) < need:
            return None
        values = {(int(slot[y + k]), int(symbol[y + k])) for y in used for k in range(w) if slot[y + k]}
        return len(used), [(v, there[kind, v]) for kind, v in sorted(values)]


def blocks(benchmark: DataFrame):
    """Benchmark items as (item_id, text), in blocks of about BLOCK bytes."""
    rows = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-size // BLOCK) or 1
    for k in range(n):
        yield [(r[0], r[1].encode()) for r in sorted(rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1]))]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_found, n_windows, coverage and slots_changed for each document and item that it holds."""
    spark, found = docs.sparkSession, None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for items in blocks(benchmark):
        bench = spark.sparkContext.broadcast(index(items))

        def run(batches, bench=bench):
            import pyarrow as pa

            m = Matcher(bench.value)
            for b in _scan.slices(batches):
                found = m.match([r or b"" for r in b.column(1).cast(pa.binary()).to_pylist()])
                out = [(doc_id, m.b["meta"][i][0], k, n, k / n, c) for doc_id, items in zip(b.column(0).to_pylist(), found) for i, k, n, c in items]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["doc_id", "item_id", "n_found", "n_windows", "coverage", "slots_changed"])

        part = _scan.over(rows, run, "doc_id long, item_id long, n_found long, n_windows long, coverage double, slots_changed long")
        found = part if found is None else found.unionByName(part)
    return found


def query(spark, sf_dir):
    return contaminated(cluster.table(spark, sf_dir, "documents"), cluster.table(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go; the others stay as they are. One scan a block of the benchmark."""
    at, schema = docs.columns.index("text"), docs.schema
    for items in blocks(cluster.table(spark, sf_dir, "benchmark")):
        bench = spark.sparkContext.broadcast(index(items))

        def run(batches, bench=bench):
            import pyarrow as pa

            m = Matcher(bench.value)
            for b in _scan.slices(batches):
                found = m.match([r or b"" for r in b.column(at).cast(pa.binary()).to_pylist()])
                yield b.filter(pa.array([not items for items in found], pa.bool_()))

        docs = _scan.over(docs, run, schema)
    return docs
