"""Subword ids through a tokenizer file, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline import cluster

cluster.ship_by_value(__name__)


def encode(c: Column, file: str) -> Column:
    """Ids of a text; null for null. The file is read once a task."""

    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(file)
        t.encode_special_tokens = True
        for s in batches:
            ids = [e.ids for e in t.encode_batch([x or "" for x in s], add_special_tokens=False)]
            yield pd.Series([None if x is None else i for x, i in zip(s, ids)])

    return F.pandas_udf(run, "array<int>", F.PandasUDFType.SCALAR_ITER)(c)


def decode(c: Column, file: str) -> Column:
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(file)
        for s in batches:
            yield pd.Series([None if x is None else t.decode([int(i) for i in x], skip_special_tokens=False) for x in s])

    return F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)(c)


TOKENS = "struct<ids:array<int>,ends:array<int>>"
#: Bytes of text that are tokenised at once: a token takes about a hundred bytes until its ids are read. Rows and bytes that Spark
#: hands to a worker at once; a smaller setting of the session stays.
GROUP, BATCH_ROWS, BATCH_BYTES = 1 << 17, 1024, 8 << 20


def _groups(batches):
    """(texts, which of them are null) of Arrow arrays, in parts of about GROUP bytes (or one text)."""
    import pyarrow.compute as pc

    for s in batches:
        lens, at, size = pc.fill_null(pc.binary_length(s), 0).to_pylist(), 0, 0
        for i, n in enumerate(lens):
            if i > at and size + n > GROUP:
                yield s.slice(at, i - at).to_pylist(), False
                at, size = i, 0
            size += n
        yield s.slice(at).to_pylist(), True


def _tokenizer(file: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(file)
    t.encode_special_tokens = True
    return t


def _encoded(t, texts: list) -> list:
    """Encodings of texts; of null ones those of an empty text. One by one: a task has one core, and threads keep memory."""
    return [t.encode(x or "", add_special_tokens=False) for x in texts]


def _local(t) -> bool:
    """Whether the tokens of a text's beginning do not depend on what comes later, but for the last two words: words are split
    by ByteLevel's pattern, which looks one character ahead and knows contractions of up to three, and nothing comes before."""
    from tokenizers import pre_tokenizers

    plain = t.normalizer is None and isinstance(t.pre_tokenizer, pre_tokenizers.ByteLevel)
    return plain and t.pre_tokenizer.use_regex and all(x.special for x in t.get_added_tokens_decoder().values())


def _cut(t, texts: list, most: int, local: bool) -> list:
    """Texts of `most` tokens or more, up to the end of the one before. If t is local, only as much of a text is tokenised as
    makes sure of these tokens."""
    out, open_, size = list(texts), [i for i, x in enumerate(texts) if x], 8 * most
    while open_:
        more = []
        for i, e in zip(open_, _encoded(t, [texts[i][:size] if local else texts[i] for i in open_])):
            if local and size < len(texts[i]) and (len(e) < most or e.token_to_word(most - 1) >= e.token_to_word(len(e) - 1) - 1):
                more.append(i)
            elif len(e) >= most:
                out[i] = texts[i][: e.token_to_chars(most - 2)[1] if most > 1 else 0]
        open_, size = more, 8 * size
    return out


def _tokens(e, most: int | None = None) -> dict:
    return {"ids": e.ids[:most], "ends": [z for _, z in e.offsets[:most]]}


def _in_groups(make, kind: str) -> Callable[[Column], Column]:
    """A function of Arrow arrays of texts: make() is called once a task and gives a function from few texts to values of `kind`."""
    from collections.abc import Iterator

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_type(_parse_datatype_string(kind))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, done = make(), []
        for texts, last in _groups(batches):
            done.append(pa.array(own(texts), arrow))
            if last:
                yield pa.concat_arrays(done)
                done = []

    return F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR_ITER)


def segmented(c: Column, file: str) -> Column:
    """ids of a text, and the character after each token's last; null for null. A token that holds part of a character ends
    where that character does."""

    def make():
        t = _tokenizer(file)
        return lambda texts: [None if x is None else _tokens(e) for x, e in zip(texts, _encoded(t, texts))]

    return _in_groups(make, TOKENS)(c)


def met(left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """Pairs (i, j) of tokens, counted from 0, that end at the same character (the first on the right), of two rising lists of
    ends. The last token of a list has no next one and takes no part, nor does an end of 0."""
    place: dict[int, int] = {}
    for j, z in enumerate(right[:-1]):
        place.setdefault(z, j)
    return [(i, place[z]) for i, z in enumerate(left[:-1]) if z > 0 and z in place]


ALIGNED = "struct<left:array<int>,right:array<int>,pairs:array<struct<left:int,right:int>>>"


def _aligned(c: Column, left: str, right: str, most: int) -> Column:
    """ids of a text under two vocabularies, and pairs, in one pass: neither the text nor tokens beyond the cut come back from a
    worker."""

    def make():
        a, b = _tokenizer(left), _tokenizer(right)
        local = _local(a)

        def both(e, f):
            e, f = _tokens(e), _tokens(f, most)
            return {"left": e["ids"], "right": f["ids"], "pairs": [{"left": i + 1, "right": j} for i, j in met(e["ends"], f["ends"])]}

        def own(texts):
            texts = _cut(a, texts, most, local)
            return [None if x is None else both(e, f) for x, e, f in zip(texts, _encoded(a, texts), _encoded(b, texts))]

        return own

    return _in_groups(make, ALIGNED)(c)


def cut_at_token(c: Column, ends: Column, n: int) -> Column:
    """The text up to the character at which its n-th token ends."""
    return F.when(F.size(ends) >= n, F.substring(c, F.lit(1), F.element_at(ends, n))).otherwise(c)


def aligned(df: DataFrame, text: str, left: str, right: str, most: int) -> DataFrame:
    """df with left_ids, right_ids and pairs (left, right) of a text under two vocabularies. A text of more than `most` - 1
    left tokens is cut where the (most - 1)-th ends; the right tokens are cut at `most`. The left has one token in front of
    the text, so its tokens count from 1."""
    cluster.lower_batches(df.sparkSession, BATCH_ROWS, BATCH_BYTES)
    (both,) = cluster.fresh(df.columns, "both")
    own = df.withColumn(both, _aligned(F.col(text), left, right, most))
    return own.select(*df.columns, *[F.col(both)[k].alias(v) for k, v in (("left", "left_ids"), ("right", "right_ids"), ("pairs", "pairs"))])
