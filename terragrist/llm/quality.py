"""Text quality by an interpolated modified Kneser-Ney model of word n-grams, trained on trusted text.

Training takes one shuffle for each length of n-gram, from the longest down. A task sends the distinct n-grams of a batch of texts with their
counts, sorted by hash and cut into shards (ranges of hashes). A shard sums them, and tells the shards of the next shorter n-grams what they
need: how many different words stand before an n-gram, and how often and with how many words of counts 1, 2, 3 or more each context goes on.
So the model is a table of integers, with a row for each shard, and no probability is rounded.

Documents are tokenised once, into blocks of a batch of texts each. A block asks the shards for the counts of its distinct n-grams, the shards
answer, and the block works out each word's probability from the answers:

    p(w | context) = rest(count of context + w) / total(context) + off(context) / total(context) * p(w | shorter context)

What is shuffled grows with the distinct n-grams of blocks, not with words times documents, and frequent n-grams need no care: a block asks
for each once. Blocks go through this in `rounds`, so that no more than a part of them is on disk at a time.

A document's perplexity is compared with a quantile of trusted documents of its language that the model was not trained on.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terragrist.llm.shared import Scratch, free, small_batches
from terragrist.llm.words import column_words

#: Trusted ids that may be broadcast (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Languages whose limits may be broadcast (4 MB or so); more are joined by a shuffle.
BROADCAST_LANGUAGES = 100_000
#: Bytes of text for each shard: some two million n-grams asked for, 16 MB.
SHARD_BYTES = 16 << 20
#: Stands before the first word of a text.
START = np.uint64(0x5BF0_3635_A5F4_1D27)


def grams(rows: np.ndarray, words: np.ndarray, order: int) -> list[np.ndarray]:
    """The hash of the k-gram that ends at each word, k = 1 to `order`; texts are preceded by as many START words as needed.

    The hash of a k-gram joins those of its first and its last k - 1 words, so it determines both.
    """
    out, first = [words], new_text(rows)
    for k, start in enumerate(starts(order)[: order - 1], 2):
        out.append(_joined(before(out[-1], first, start), out[-1], k))
    return out


def new_text(rows: np.ndarray) -> np.ndarray:
    """True for the first word of each text."""
    return np.concatenate([np.ones(min(1, len(rows)), bool), rows[1:] != rows[:-1]])


def before(gram: np.ndarray, first: np.ndarray, start: np.uint64) -> np.ndarray:
    """The n-gram that ends one word earlier."""
    out = np.empty_like(gram)
    out[1:] = gram[:-1]
    out[first] = start
    return out


def _joined(context: np.ndarray, tail: np.ndarray, k: int) -> np.ndarray:
    """Hash of a k-gram. Hashes of words are well mixed, so turning one and adding the other bit by bit will do."""
    turn = np.uint64(2 * k + 1)
    return ((context << turn) | (context >> (np.uint64(64) - turn))) ^ tail


def starts(order: int) -> list[np.uint64]:
    """The hash of k START words, k = 1 to `order`."""
    out = [np.array([START])]
    for k in range(2, order + 1):
        out.append(_joined(out[-1], out[-1], k))
    return [x[0] for x in out]


def _gram_of(chain: np.ndarray) -> np.ndarray:
    """Hashes of k-grams from their chains: the contexts (of k - 1 words, k - 2, ..., one) and the last word."""
    out = chain[-1]
    for k, context in enumerate(chain[-2::-1], 2):
        out = _joined(context, out, k)
    return out


def _start_chain(k: int) -> np.ndarray:
    """The chain of k START words, the only k-gram that goes before words but ends at none."""
    s = starts(k)
    return np.array([*s[k - 2 :: -1], START] if k > 1 else s, np.uint64)


def _bytes(columns: np.ndarray) -> bytes:
    """Columns with all first bytes of one together, then its second ones, and so on: the many that are zero then take no room in a shuffle."""
    n, size = columns.shape
    return np.ascontiguousarray(columns).view(np.uint8).reshape(n, size, columns.itemsize).transpose(0, 2, 1).tobytes()


def _columns(blob: pa.Scalar, n: int, kind: type = np.uint64) -> np.ndarray:
    """The columns that _bytes() was given."""
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(blob.as_buffer(), np.uint8).reshape(n, size, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind).reshape(n, planes.shape[2])


def _sorted_bytes(gram: np.ndarray) -> bytes:
    """Sorted hashes as steps from one to the next, which have fewer digits."""
    return _bytes(np.diff(gram, prepend=np.uint64(0))[None])


def _sorted(blob: pa.Scalar) -> np.ndarray:
    return np.cumsum(_columns(blob, 1)[0], dtype=np.uint64)


def _side_by_side(blobs: pa.ChunkedArray, n: int) -> np.ndarray:
    return np.concatenate([np.empty((n, 0), np.uint64), *(_columns(b, n) for b in blobs)], axis=1)


def _shard(gram: np.ndarray, bits: int) -> np.ndarray:
    return gram >> np.uint64(64 - bits)


def _cut(gram: np.ndarray, columns: np.ndarray | None, bits: int) -> Iterator[tuple[int, bytes]]:
    """(shard, its columns as bytes) of sorted n-grams; without columns, its n-grams."""
    shard = _shard(gram, bits)
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(shard)), bool), shard[1:] != shard[:-1]]))
    for lo, hi in zip(at, [*at[1:], len(shard)]):
        yield int(shard[lo]), _sorted_bytes(gram[lo:hi]) if columns is None else _bytes(columns[:, lo:hi])


#: A message to a shard. `kind` 0: chains of n-grams and their counts; 1: contexts with total, and with the number of words of counts 1, 2, 3 or more.
MESSAGE = "shard long, kind int, body binary"
#: A shard of one level. `counts`: for each n-gram its count, and below the longest also total and numbers of words as a context.
LEVEL = "shard long, chain binary, counts binary, ones long, twos long, threes long, fours long, known long, total long"


def _messages(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    shard, kind, body = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(kind, pa.int32()), pa.array(body, pa.binary())], ["shard", "kind", "body"])


def count_ngrams(texts: DataFrame, order: int, bits: int, part: int = 0, parts: int = 1) -> DataFrame:
    """Messages with the distinct n-grams of each batch of texts (one column), for one in `parts` of the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = starts(order)
        for batch in batches:
            rows, words = column_words(batch.column(0))
            every, first = grams(rows, words, order), new_text(rows)
            gram, at, n = np.unique(every[-1], return_index=True, return_counts=True)
            mine = _shard(gram, bits) % np.uint64(parts) == np.uint64(part)
            gram, at, n = gram[mine], at[mine], n[mine]
            contexts = [before(every[k - 2], first, start[k - 2])[at] for k in range(order, 1, -1)]
            yield _messages([(s, 0, b) for s, b in _cut(gram, np.array([*contexts, words[at], n.astype(np.uint64)]), bits)])

    return texts.mapInArrow(run, MESSAGE)


def _sum_messages(k: int, top: bool):
    """The row of a shard of k-grams from all messages to it."""

    def run(key: tuple[pa.Scalar, ...], messages: pa.Table) -> pa.Table:
        kind = messages["kind"].to_numpy()
        said = _side_by_side(messages["body"].filter(pa.array(kind == 0)), k + 1)
        context = _side_by_side(messages["body"].filter(pa.array(kind == 1)), 5)
        gram, at = np.unique(np.concatenate([_gram_of(said[:k]), context[0]]), return_inverse=True)
        mine, others = at[: said.shape[1]], at[said.shape[1] :]
        chain = np.repeat(_start_chain(k)[:, None], len(gram), axis=1)
        chain[:, mine] = said[:k]
        counts = np.zeros((1 if top else 5, len(gram)), np.int64)
        np.add.at(counts[0], mine, said[k].view(np.int64))
        for i in range(1, len(counts)):
            np.add.at(counts[i], others, context[i].view(np.int64))
        n = counts[0]
        tallies = [int((n == i).sum()) for i in (1, 2, 3, 4)] + [int((n > 0).sum()), int(n.sum())]
        values = [key[0].as_py(), _bytes(chain), _bytes(counts), *tallies]
        names = [c.split()[0] for c in LEVEL.split(", ")]
        kinds = [pa.binary() if "binary" in c else pa.int64() for c in LEVEL.split(", ")]
        return pa.table([pa.array([v], t) for v, t in zip(values, kinds)], names)

    return run


def _tell_below(k: int, top: bool, bits: int):
    """Messages of shards of k-grams to those of (k - 1)-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, n in zip(batch.column(0), batch.column(1)):
                chain, n = _columns(c, k), _columns(n, 1 if top else 5, np.int64)[0]
                chain, n = chain[:, n > 0], n[n > 0]
                gram, at, different = np.unique(_gram_of(chain[1:]), return_index=True, return_counts=True)
                rows = [(s, 0, b) for s, b in _cut(gram, np.array([*chain[1:, at], different.astype(np.uint64)]), bits)]
                order = np.argsort(chain[0])
                context, at = np.unique(chain[0][order], return_index=True)
                n = n[order]
                sums = [np.add.reduceat(x.astype(np.int64), at) if len(at) else np.empty(0, np.int64) for x in (n, n == 1, n == 2, n > 2)]
                yield _messages(rows + [(s, 1, b) for s, b in _cut(context, np.array([context, *(x.view(np.uint64) for x in sums)]), bits)])

    return run


def _packed(k: int):
    """(shard, gram, counts) of the shards of a level: hashes in place of chains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = [_sorted_bytes(_gram_of(_columns(c, k))) for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gram, pa.binary()), batch.column(2)], ["shard", "gram", "counts"])

    return run


def discounts(ones: int, twos: int, threes: int, fours: int) -> tuple[float, float, float]:
    """What counts of one, two, and three or more give to the level below, from the numbers of n-grams with counts 1 to 4.

    Where so few n-grams are known that the estimate leaves (0, count], it is cut to 0.1 or the count.
    """
    y = ones / max(1, ones + 2 * twos)
    raw = (1 - 2 * y * twos / max(1, ones), 2 - 3 * y * threes / max(1, twos), 3 - 4 * y * fours / max(1, threes))
    return tuple(min(max(v, 0.1), float(top)) for v, top in zip(raw, (1, 2, 3)))


class Model:
    """`shards`: (level, shard, gram, counts), a row for each shard of each length of n-grams; `discounts`: by length; `total`, `unknown`: of
    single words, the sum of their counts, and the probability of a word that trusted text does not have (1 without trusted text)."""

    def __init__(self, shards: DataFrame | None, bits: int, discounts: list[tuple[float, float, float]], total: int, unknown: float) -> None:
        self.shards, self.bits, self.discounts, self.total, self.unknown = shards, bits, discounts, total, unknown

    @property
    def order(self) -> int:
        return len(self.discounts)


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0


def rounds_for(size: int, most: int = 8, least_bytes: int = 16 << 20) -> int:
    """Rounds by the bytes of all texts: at most `most`, and none for less than `least_bytes`. They change how much is on disk at a time, no results."""
    return max(1, min(most, size // least_bytes))


def bits_for(size: int) -> int:
    """2^bits shards for so many bytes of text. They change how much a task holds, no results."""
    return max(1, (size // SHARD_BYTES).bit_length())


def _grouped(messages: DataFrame, k: int, top: bool) -> DataFrame:
    return messages.groupBy("shard").applyInArrow(_sum_messages(k, top), LEVEL)


def train(trusted: DataFrame, scratch: Scratch, text_col: str = "text", *, order: int = 2, rounds: int = 2, bits: int = 3) -> Model:
    """Counts of all n-grams of up to `order` words of the trusted texts, in 2^`bits` shards; the longest are counted in `rounds`."""
    texts = trusted.select(F.col(text_col).cast("string").alias("text"))
    level, tallies, shards, given = [], [], [], []
    for r in range(rounds):
        level.append(scratch.table(_grouped(count_ngrams(texts, order, bits, r, rounds), order, True), f"level-{order}-{r}"))
        tallies.append(_tallies(level[-1]))
        free()
    for k in range(order, 0, -1):
        every = _union(level)
        ones, twos, threes, fours, known, total = np.sum(tallies, axis=0).tolist()
        given.insert(0, discounts(ones, twos, threes, fours))
        packed = every.select("shard", "chain", "counts").mapInArrow(_packed(k), "shard long, gram binary, counts binary")
        shards.append(scratch.table(packed, f"shards-{k}").withColumn("level", F.lit(k)))
        if k > 1:
            level = [scratch.table(_grouped(every.select("chain", "counts").mapInArrow(_tell_below(k, k == order, bits), MESSAGE), k - 1, False), f"level-{k - 1}-0")]
            tallies = [_tallies(level[0])]
        scratch.drop(*[f"level-{k}-{r}" for r in range(rounds if k == order else 1)])
        free()
    if not known:
        return Model(None, bits, given, 0, 1.0)
    off = np.dot(given[0], [ones, twos, known - ones - twos])
    return Model(_union(shards), bits, given, total, float(off) / total / (known + 1))


def _tallies(level: DataFrame) -> list[int]:
    return list(level.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("ones", "twos", "threes", "fours", "known", "total")]).first())


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


#: Rows of one batch: its distinct words, sorted, and the place among these of each word in turn.
BLOCK = "block long, doc_id array<long>, lang array<string>, words array<long>, vocabulary binary, places binary"
ANSWER = "block long, level int, shard long, body binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block for each batch of (doc_id, lang, text). Its number is drawn by chance and stands once the block is written."""
    for batch in batches:
        if not len(batch):
            continue
        rows, words = column_words(batch.column(2))
        vocabulary, places = np.unique(words, return_inverse=True)
        one = [[uuid.uuid4().int >> 65], [batch.column(0).to_pylist()], [batch.column(1).to_pylist()], [np.bincount(rows, minlength=len(batch)).tolist()]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64())]
        arrays = [pa.array(v, t) for v, t in zip(one, kinds)]
        arrays += [pa.array([x], pa.binary()) for x in (_sorted_bytes(vocabulary), _bytes(places.astype(np.uint32)[None]))]
        yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in BLOCK.split(", ")])


def _block_grams(words: np.ndarray, vocabulary: pa.Scalar, places: pa.Scalar, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(row of each word, its n-grams by length) of a block with so many words in each row."""
    rows = np.repeat(np.arange(len(words)), words)
    return rows, grams(rows, _sorted(vocabulary)[_columns(places, 1, np.uint32)[0]], order)


def _asked(every: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The n-grams of each length that a block asks for, sorted: those at its words, and START words as contexts."""
    for k, gram in enumerate(every, 1):
        yield np.unique(np.append(gram, starts(k)[-1]) if k < len(every) else gram)


def _ask(order: int, bits: int):
    """(block, level, shard, body) with the n-grams that each block asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, vocabulary, places in zip(*batch.columns):
                every = _block_grams(np.array(words.as_py(), np.int64), vocabulary, places, order)[1]
                rows = [(k, s, b) for k, gram in enumerate(_asked(every), 1) for s, b in _cut(gram, None, bits)] if len(every[0]) else []
                level, shard, body = zip(*rows) if rows else ((), (), ())
                arrays = [pa.array([block.as_py()] * len(rows), pa.int64()), pa.array(level, pa.int32()), pa.array(shard, pa.int64()), pa.array(body, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["block", "level", "shard", "body"])

    return run


def _answer(order: int):
    """Counts of the n-grams that blocks ask one shard for, zeros for unknown ones, in the order asked."""

    def run(key: tuple[pa.Scalar, ...], asked: pa.Table, shard: pa.Table) -> pa.Table:
        n = 5 if key[0].as_py() < order else 1
        wanted = [_sorted(b) for b in asked["body"]]
        every = np.concatenate([np.empty(0, np.uint64), *wanted])
        counts = np.zeros((n, len(every)), np.int64)
        if shard.num_rows and len(every):
            gram, have = _sorted(shard["gram"][0]), _columns(shard["counts"][0], n, np.int64)
            at = np.minimum(np.searchsorted(gram, every), len(gram) - 1)
            counts[:] = have[:, at] * (gram[at] == every)
        ends = np.cumsum([len(w) for w in wanted])
        body = [_bytes(counts[:, e - len(w) : e]) for w, e in zip(wanted, ends)]
        return pa.table([asked["block"], asked["level"], asked["shard"], pa.array(body, pa.binary())], ["block", "level", "shard", "body"])

    return run


def _read(given: list[tuple[float, float, float]], total: int, unknown: float):
    """(doc_id, lang, perplexity) of the rows of one block from the answers to it."""
    order = len(given)

    def counts_of(answers: pa.Table, k: int) -> np.ndarray:
        n = 5 if k < order else 1
        mine = np.flatnonzero(answers["level"].to_numpy() == k)
        mine = mine[np.argsort(answers["shard"].to_numpy()[mine])]
        return np.concatenate([np.empty((n, 0), np.int64), *(_columns(answers["body"][int(i)], n, np.int64) for i in mine)], axis=1)

    def rest(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
        return n - np.array([0.0, *d])[np.minimum(n, 3)]

    def run(key: tuple[pa.Scalar, ...], block: pa.Table, answers: pa.Table) -> pa.Table:
        words = np.array(block["words"][0].as_py(), np.int64)
        perplexity = np.full(len(words), np.nan)
        if words.any():
            rows, every = _block_grams(words, block["vocabulary"][0], block["places"][0], order)
            first, start = new_text(rows), starts(order)
            p = np.full(len(rows), unknown)
            context = np.empty((5, 0), np.int64)
            for k, asked in enumerate(_asked(every), 1):
                counts, at = counts_of(answers, k) if total else np.zeros((5, len(asked)), np.int64), np.searchsorted(asked, every[k - 1])
                n = counts[0][at]
                if k == 1:
                    p += rest(n, given[0]) / max(1, total)
                else:
                    seen, off = context[1], np.array(given[k - 1]) @ context[2:]
                    p = np.where(seen > 0, (rest(n, given[k - 1]) + off * p) / np.maximum(seen, 1), p)
                if k < order:
                    context = counts[:, before(at, first, np.searchsorted(asked, start[k - 1]))]
            with np.errstate(invalid="ignore", divide="ignore"):
                perplexity = np.exp(-np.bincount(rows, weights=np.log(p), minlength=len(words)) / words)
        columns = [block["doc_id"][0].values, block["lang"][0].values, pa.array(perplexity, mask=words == 0)]
        return pa.table(columns, ["doc_id", "lang", "perplexity"])

    return run


def perplexity(docs: DataFrame, model: Model, scratch: Scratch, id_col: str, text_col: str, lang_col: str, rounds: int = 1) -> DataFrame:
    """(doc_id, lang, perplexity) of each row, over its whole text; null for texts without words."""
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    out = []
    for r in range(rounds):
        mine = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == r)
        blocks = scratch.table(mine.mapInArrow(_blocks, BLOCK), f"blocks-{r}")
        free()  # Spark holds on to the last query, so what the round before has shuffled goes only now
        out.append(scratch.table(_scored(blocks, model), f"scored-{r}"))
        scratch.drop(f"blocks-{r}")
    return _union(out)


def _scored(blocks: DataFrame, model: Model) -> DataFrame:
    asked = blocks.select("block", "words", "vocabulary", "places").mapInArrow(_ask(model.order, model.bits), ANSWER)
    if model.shards is not None:
        asked = asked.groupBy("level", "shard").cogroup(model.shards.groupBy("level", "shard")).applyInArrow(_answer(model.order), ANSWER)
    read = _read(model.discounts, model.total, model.unknown)
    return blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(read, "doc_id long, lang string, perplexity double")


def classify(
    docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, quantile: float = 0.99, order: int = 2, held_out: int = 5, rounds: int | None = None
) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, kept) for each row of `docs`.

    `trusted_ids`: one id column. One in `held_out` of these (by a hash of the id) is kept out of training and gives the limits: a
    document is kept if its perplexity is at most the `quantile` of the held-out documents of its language (of all held-out
    documents, if its language has none; null lang counts as `und`). `order`: words of the longest n-grams. `rounds`: see rounds_for.

    Texts without words (null, empty, white space) have a null perplexity and are not kept. Without trusted text every document with words has
    perplexity 1; without held-out text every document with words is kept, with a null threshold. Repeated rows are each answered and each
    count; rows with a null id are never trusted; other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "quality")
    ids = trusted_ids.toDF("doc_id").select(F.col("doc_id").cast("long")).filter("doc_id is not null").distinct()
    ids = scratch.table(ids.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(held_out)) == 0), "trusted")
    near = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = text_bytes(docs, text_col)
    rounds = rounds or rounds_for(size)
    model = train(texts.join(near.filter("not held"), "doc_id", "left_semi"), scratch, order=order, rounds=min(rounds, 2), bits=bits_for(size))
    scored = perplexity(docs, model, scratch, id_col, text_col, lang_col, rounds)
    known = scored.join(near.filter("held"), "doc_id", "left_semi")
    limits = scratch.table(known.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10000).alias("own")), "limits")
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_LANGUAGES else limits  # one language may hold most rows
    overall = known.agg(F.percentile_approx("perplexity", quantile, 10000)).first()[0]
    out = scored.join(limits, "lang", "left")
    threshold = F.coalesce("own", F.lit(overall).cast("double"))
    out = out.select("doc_id", "lang", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.col("perplexity").isNotNull() & threshold.isNull()).alias("kept"))
    out = scratch.table(out, "result")
    scratch.drop_all_but("result")
    return out
