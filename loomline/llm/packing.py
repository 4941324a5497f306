"""Vector bin packing of token sequences.

An example has three weights: tokens, segments (one) and loss-bearing tokens. A sequence holds at most max_tokens,
max_segments and max_loss of them. The dot-product heuristic fills one sequence at a time: of a pool of waiting examples
that fit in all three, it takes the one whose weights have the largest dot product with what is left, each as a share of
its limit, so that an example heavy in the scarcer dimension comes when that dimension is still open.

Documents may be cut: whole windows of max_tokens become sequences of their own, the rest goes to the pool, and when no
waiting piece fits, one is cut to fill the sequence. What remains at the end of a partition is laid out in sequences whose
lengths are powers of two, which need no padding. With cuts, only the limit on segments or loss can leave padding.

Plain documents bear loss on all tokens but a document's first, so in the query and the stage the limits on tokens and
segments decide; pack_examples has all three.

Packing needs no shuffle: each partition packs its own rows, and sequence ids start with the partition's number.

Defined cases: null and empty texts are one id (the end mark); repeated rows are packed each; an empty table gives an
empty result; texts of any length are cut; only doc_id and text are read, by the stage too, which also packs null texts. Of
places that fit equally well the first counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline import cluster
from loomline.llm import _scan

cluster.ship_by_value(__name__)

MAX_TOKENS, MAX_SEGMENTS, POOL = 2048, 128, 512
#: A sequence that lacks no more than so many tokens is padded rather than cut at powers of two.
FILLED = 32
END = 1
#: Texts of these characters only are split by _scan; others go through the tokenizer's own code.
PLAIN = "[^\t-\r\x20-\x7eÀ-ÖØ-öø-įı-ɏ]"


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of the word-end BPE file. Pieces (what its pattern splits) are found by vectorised scanning; a piece's ids do not
    depend on its neighbours, so each different piece is encoded once a task, many in one text, and then looked up."""

    LIMIT = 4_000_000

    def __init__(self, file: str):
        import json
        import os
        import re

        import numpy as np
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.own = Tokenizer.from_file(file)
        self.own.encode_special_tokens = True
        with open(file) as f:
            vocab = json.load(f)["model"]["vocab"]
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.hasher, self.plain = _scan.Hasher(), re.compile(PLAIN)
        self.cls = _scan.byte_classes()
        self.clear()

    def clear(self):
        import numpy as np

        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted piece hashes; their numbers
        self.first, self.lens, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def pieces(self, buf):
        """Bounds of the pieces of lower-case text: runs of letters, single digits, runs of others, and contractions."""
        import numpy as np

        cls = self.cls[buf]
        change = np.concatenate([[True], cls[1:] != cls[:-1]])
        change |= cls == _scan.DIGIT
        mark = np.flatnonzero((buf[:-2] == 39) & (cls[1:-1] == _scan.LETTER)) if len(buf) > 2 else np.zeros(0, np.int64)
        mark = mark[change[mark]]  # an apostrophe that begins a run, before a letter
        if len(mark):
            b1, b2 = buf[mark + 1], buf[mark + 2]
            one = np.isin(b1, list(b"stmd"))
            two = ((b1 == 114) | (b1 == 118)) & (b2 == 101) | (b1 == 108) & (b2 == 108)
            change[mark[one | two] + 1] = False
            change[mark[one] + 2] = True
            after = mark[two] + 3
            change[after[after < len(buf)]] = True
        starts = np.flatnonzero(change)
        ends = np.append(starts[1:], len(buf))
        keep = cls[starts] != _scan.SPACE
        return starts[keep], ends[keep]

    def _learn(self, words: list[bytes], hashes):
        """Encode pieces that have not been seen, joined by spaces, and cut the ids where a word ends."""
        import numpy as np

        ids, ends = [], []
        chunks = [words[i : i + 4096] for i in range(0, len(words), 4096)]
        for chunk, e in zip(chunks, self.own.encode_batch_fast([b" ".join(c).decode() for c in chunks], add_special_tokens=False)):
            got = np.array(e.ids, np.uint32)
            stops = np.flatnonzero(self.last[got]) + 1
            if len(stops) != len(chunk):
                each = [np.array(self.own.encode(w.decode(), add_special_tokens=False).ids, np.uint32) for w in chunk]
                got, stops = np.concatenate(each), np.cumsum([len(x) for x in each])
            ends.append(stops + sum(map(len, ids)))
            ids.append(got)
        stops = np.concatenate(ends)
        n = len(self.lens)
        self.first = np.concatenate([self.first, len(self.flat) + np.concatenate([[0], stops[:-1]])])
        self.lens = np.concatenate([self.lens, np.diff(stops, prepend=0)])
        self.flat = np.concatenate([self.flat, *ids])
        spot = np.searchsorted(self.keys, hashes)  # both are sorted
        self.keys, self.at = np.insert(self.keys, spot, hashes), np.insert(self.at, spot, np.arange(n, n + len(words)))

    def _plain(self, raws: list[bytes]):
        """Ids of plain lower-case texts: flat, and their bounds by text."""
        import numpy as np

        buf = np.frombuffer(b"\n".join(raws), np.uint8)
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(raws) + 1, np.int64)
        starts, ends = self.pieces(buf)
        hashes = self.hasher.spans(buf, starts, ends)
        uniq, first, inv = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(uniq) > self.LIMIT:
            self.clear()
        spot = np.minimum(np.searchsorted(self.keys, uniq), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[spot] != uniq) if len(self.keys) else np.arange(len(uniq))
        if len(new):
            raw = buf.tobytes()
            self._learn([raw[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist())], uniq[new])
            spot = np.searchsorted(self.keys, uniq)
        word = self.at[spot][inv] if len(uniq) else np.zeros(0, np.int64)
        lens = self.lens[word]
        upto = np.cumsum(lens)
        flat = self.flat[np.repeat(self.first[word] - (upto - lens), lens) + np.arange(upto[-1] if len(upto) else 0)]
        edges = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])
        return flat, np.concatenate([[0], upto])[np.searchsorted(starts, edges)]

    def encode(self, texts: list[str]):
        """An array of ids for each text."""
        import numpy as np

        out = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if not self.plain.search(t)]
        raws = {i: texts[i].lower().encode() for i in plain}
        for i in set(range(len(texts))) - set(plain):
            out[i] = np.array(self.own.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        for group in _scan.groups([raws[i] for i in plain]):
            own = [plain[g] for g in group]
            if len(own) == 1 and len(raws[own[0]]) > 1 << 22:
                parts, raw, at = [], raws[own[0]], 0
                while at < len(raw):  # cut before white space, where no piece can go on
                    end = at + (1 << 21)
                    while end < len(raw) and self.cls[raw[end]] != _scan.SPACE:
                        end += 1
                    parts.append(self._plain([raw[at:end]])[0])
                    at = end
                out[own[0]] = np.concatenate(parts)
                continue
            flat, edges = self._plain([raws[i] for i in own])
            for i, s, e in zip(own, edges[:-1].tolist(), edges[1:].tolist()):
                out[i] = flat[s:e]
        return out


class Packer:
    """The dot-product heuristic over a pool. Items are (tokens, loss, tag, start); a closed sequence is a list of
    (tag, start, length) in order. cut: items may be split, and their loss lies on all tokens but `skip` first ones."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, pool: int = POOL, cut: bool = False):
        import numpy as np

        self.limit = np.array([max_tokens, max_segments, max_loss], float)
        self.cut, self.size = cut, pool
        self.w = np.zeros((pool + 1, 3))
        self.items: list = []

    def add(self, tokens: int, loss: int, tag, start: int = 0):
        """Wait with an item; returns a closed sequence if the pool is full."""
        if tokens > self.limit[0] or loss > self.limit[2]:
            raise ValueError(f"an example of {tokens} tokens and {loss} loss-bearing tokens is over the limits")
        self.w[len(self.items)] = tokens, 1, loss
        self.items.append((tag, start))
        return self.fill() if len(self.items) > self.size else None

    def _take(self, k: int):
        item, n = self.items[k], len(self.items) - 1
        self.items[k] = self.items[n]
        self.w[k] = self.w[n]
        self.items.pop()
        return item

    def fill(self):
        """One sequence of waiting items."""
        left, out = self.limit.copy(), []
        while self.items:
            w = self.w[: len(self.items)]
            score = (w / self.limit) @ (left / self.limit)
            score[(w > left).any(1)] = -1
            k = int(score.argmax())
            if score[k] < 0:
                break
            out.append((*self.items[k], int(w[k, 0])))
            left -= w[k]
            self._take(k)
        if self.cut and self.items and left[0] >= 1 and left[1] >= 1:
            k = int((self.w[: len(self.items)] @ (left / self.limit**2)).argmax())
            tag, start = self.items[k]
            skip = self.w[k, 0] - self.w[k, 2]
            n = int(min(left[0], left[2] + skip))
            if 0 < n < self.w[k, 0]:
                out.append((tag, start, n))
                self.items[k] = (tag, start + n)
                self.w[k] = self.w[k, 0] - n, 1, self.w[k, 0] - n
        return out

    def rest(self):
        while self.items:
            yield self.fill()


def powers(seq, max_tokens: int):
    """Cut a sequence of pieces at the powers of two of its length."""
    total, out = sum(p[2] for p in seq), []
    sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1] if total < max_tokens else [total]
    queue = list(seq)
    for size in sizes:
        own = []
        while size:
            tag, start, n = queue.pop(0)
            k = min(n, size)
            own.append((tag, start, k))
            size -= k
            if k < n:
                queue.insert(0, (tag, start + k, n - k))
        out.append(own)
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack_documents(docs: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, file: str | None = None, ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens (all but a
    document's first id), and with ids=True the ids themselves."""
    file = file or tokenizer_file()

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        tok, packer = WordTokenizer(file), Packer(max_tokens, max_segments, max_tokens, cut=True)
        rows, parts, n_seq, tokens = [], [], 0, {}

        def close(seq):
            nonlocal n_seq
            at = 0
            for tag, start, n in seq:
                doc_id, arr, left = tokens[tag]
                part = arr[start : start + n]
                rows.append((doc_id, start, n, zlib.crc32(part.astype("<u4").tobytes()), len(arr), base + n_seq, at, n - (start == 0)))
                if ids:
                    parts.append(part.astype(np.int32))
                at += n
                if left == n:
                    del tokens[tag]
                else:
                    tokens[tag][2] -= n
            n_seq += 1

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"] + ["ids"] * ids

        def flush():
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
            if ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)), pa.array(np.concatenate(parts))))
            rows.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays(cols, names=names)

        tag = 0
        for b in _scan.slices(batches, 512):
            for doc_id, arr in zip(b.column(0).to_pylist(), tok.encode([t or "" for t in b.column(1).to_pylist()])):
                arr = np.append(arr, np.uint32(END))
                tokens[tag] = [doc_id, arr, len(arr)]
                whole = len(arr) // max_tokens * max_tokens
                for at in range(0, whole, max_tokens):
                    close([(tag, at, max_tokens)])
                if whole < len(arr):
                    n = len(arr) - whole
                    if (seq := packer.add(n, n - (whole == 0), tag, whole)) is not None:
                        for own in [seq] if sum(p[2] for p in seq) > max_tokens - FILLED else powers(seq, max_tokens):
                            close(own)
                tag += 1
            if len(rows) > 512:
                yield flush()
        for seq in packer.rest():
            if packer.items and sum(p[2] for p in seq) > max_tokens - FILLED:
                close(seq)
            else:  # the last sequence, and those that the limit on segments left open
                for own in powers(seq, max_tokens):
                    close(own)
        if rows:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _scan.over(rows, run, SCHEMA + ", ids array<int>" * ids)


def pack_examples(examples: DataFrame, id: str, tokens: str, loss: str, max_tokens: int, max_segments: int, max_loss: int, pool: int = POOL) -> DataFrame:
    """Instruction data: whole examples under all three limits. Returns example_id, sequence_id, offset; an example that is
    over a limit by itself is in no sequence and has nulls there. Null counts are 0."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        base, n_seq = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36, 0
        packer, rows = Packer(max_tokens, max_segments, max_loss, pool), []

        def close(seq):
            nonlocal n_seq
            at = 0
            for tag, _, n in seq:
                rows.append((tag, base + n_seq, at))
                at += n
            n_seq += 1

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["example_id", "sequence_id", "offset"])
            rows.clear()
            return out

        for b in batches:
            for x, n, k in zip(*(c.to_pylist() for c in b.columns)):
                n, k = max(n or 0, 0), max(k or 0, 0)
                if n > max_tokens or k > max_loss:
                    rows.append((x, None, None))
                elif (seq := packer.add(n, k, x)) is not None:
                    close(seq)
                if len(rows) > 1024:
                    yield flush()
        for seq in packer.rest():
            close(seq)
        if rows:
            yield flush()

    rows = examples.select(F.col(id).cast("long"), F.col(tokens).cast("long"), F.col(loss).cast("long"))
    return _scan.over(rows, run, "example_id long, sequence_id long, offset long")


def query(spark, sf_dir):
    return pack_documents(cluster.table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the pieces with their ids."""
    return pack_documents(docs, ids=True)
