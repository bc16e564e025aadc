"""Document scores of a gated recurrent language model that learns from the whole corpus.

1. Texts become blocks of bounded size: local word numbers per document, and the block's distinct words with
   their training counts. That is written once.
2. Words of all blocks are counted together (a shuffle of block vocabularies, not of tokens). The words that most
   blocks have - at most ``COMMON_WORDS``, none longer than ``COMMON_BYTES`` - are counted by partial sums and
   their counts broadcast, so no task gets a row of a common word from every block; all others meet by word once.
   Each block gets the code and the exact count of each of its words back, as packed arrays, and is written as one
   row that training and scoring read without another exchange.
3. The network (see ``gru``) starts from about ``SEED_TOKENS`` tokens, ``seed_passes`` times over, and is then
   trained on the training documents of every block, each by itself; the blocks' weights are averaged,
   weighted by tokens, in two steps of sums. Only the averaged weights, of fixed size, reach the driver.
4. Every block is scored, states carried through whole documents.

The probability of a word outside the head, given its class, comes from discounted counts. What they leave goes
to words never seen in training, spelled from their end by a Markov chain over the bytes of the distinct training
words: the last two bytes given the class, then each byte given the three after it. The spellings of all words
of a class add up to one, so all words together have no more than one.

Memory is bounded by the block; no vocabulary is broadcast but the common words, whose number and size are bounded.

Defined results: null and empty texts are the end token alone; rows with a null id are scored and held out
of training; repeated rows count each. Blocks follow the partitions read, so weights - not counts or base
scores - can differ slightly when the same table is cut otherwise. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import gru
from .common import crc_mod, staged, text_rows

BLOCK_BYTES = 16 << 20
#: Words never hold white space, so this can stand for the end.
END_WORD = b" "
SEED_RATE, RATE, SEED_PASSES = 6e-3, 3e-3, 8
#: Tokens of the block that the network starts from; after this it is trained on every block as a whole.
SEED_TOKENS = 300_000
CHUNK = 2048
#: Words that are counted by partial sums and broadcast, from the most frequent ones of every block.
COMMON_WORDS, COMMON_BYTES, BLOCK_COMMON = 131_072, 64, 16_384
#: Codes that a task gathers before it packs them by block.
GATHER_ROWS = 1 << 20
_TOKENS = "block long, id long, held boolean, ids binary, local int, word binary, c long, cls int, common boolean"
_CODES = "block long, locals binary, codes binary, counts binary, unseen array<int>, words array<binary>"
_BLOCK = "block long, id array<long>, held array<boolean>, ids array<binary>, codes binary, counts binary, unseen array<int>, words array<binary>"
_PARTS = "chunk int, part int, weight double, total binary"


def packed(numbers: np.ndarray) -> bytes:
    """Numbers of 0 and more as planes of bytes, compressed; planes of zeros at the end are left out."""
    used = max(1, -(-int(numbers.max()).bit_length() // 8)) if len(numbers) else 1
    width = 1 << (used - 1).bit_length()
    planes = np.ascontiguousarray(numbers, f"<u{width}").view(np.uint8).reshape(-1, width).T
    return used.to_bytes(1, "big") + zstd.compress(np.ascontiguousarray(planes[:used]).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstd.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    width = 4 if data[0] < 4 else 8
    out = np.zeros((planes.shape[1], width), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<i4" if width == 4 else "<i8").ravel()


class Numbers(dict):
    """Words by number, in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _tokenise():
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.bool_()]
    names = ["block", "id", "held", "ids", "local", "word", "c", "cls", "common"]

    def tokenise(batches):
        part, number = TaskContext.get().partitionId(), 0
        vocab = Numbers({END_WORD: 0})
        rows: list[tuple] = []
        size = 0

        def flush():
            nonlocal number, size
            block = part << 24 | number
            ids = {held: [unpacked(r[2]) for r in rows if r[1] is held] for held in (False, True)}
            counts, out = (np.bincount(np.concatenate(x), minlength=len(vocab)) if x else np.zeros(len(vocab), np.int64) for x in ids.values())
            every = counts + out
            common = np.zeros(len(vocab), bool)
            common[np.argpartition(-every, BLOCK_COMMON)[:BLOCK_COMMON] if len(every) > BLOCK_COMMON else slice(None)] = True
            n = len(rows)
            yield pa.record_batch([pa.array([block] * n, types[0]), pa.array([r[0] for r in rows], types[1]), pa.array([r[1] for r in rows], types[2]), pa.array([r[2] for r in rows], types[3]), *(pa.nulls(n, t) for t in types[4:])], names)
            words = list(vocab)
            for a in range(0, len(words), 50_000):
                some = words[a : a + 50_000]
                m = len(some)
                cls = np.fromiter(map(word_class, some), np.int32, m)
                yield pa.record_batch([pa.array([block] * m, types[0]), *(pa.nulls(m, t) for t in types[1:4]), pa.array(np.arange(a, a + m), types[4]), pa.array(some, types[5]), pa.array(counts[a : a + m], types[6]), pa.array(cls, types[7]), pa.array(common[a : a + m], types[8])], names)
            vocab.clear()
            vocab[END_WORD] = 0
            rows.clear()
            number, size = number + 1, 0

        for batch in batches:
            for i, text, held in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("held").to_pylist(), strict=True):
                words = text.lower().split()  # of bytes: A-Z alone are lowered, ASCII white space alone parts words
                words.append(END_WORD)
                rows.append((i, held, packed(np.fromiter(map(vocab.__getitem__, words), np.int32, len(words)))))
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield from flush()
        if rows:
            yield from flush()

    return tokenise


class CorpusCounts:
    """Numbers of fixed size from the counts of all words."""

    def __init__(self, n: int, v: int, head: list[tuple[bytes, int]], tail: list[tuple[int, int, int]]):
        self.n, self.v = n, v
        self.head_counts = np.zeros(gru.HEAD)
        self.head_counts[: len(head)] = [c for _, c in head]
        self.tail_total, self.tail_types = np.zeros(gru.TAIL), np.zeros(gru.TAIL)
        for cls, total, types in tail:
            self.tail_total[cls], self.tail_types[cls] = total, types

    def tail_log(self, cls: np.ndarray, c: np.ndarray) -> np.ndarray:
        """ln P(word | tail class) of seen words by discounted counts; of unseen ones what is left for all of them."""
        seen = np.where(c > 0, c - gru.DISCOUNT, gru.DISCOUNT * self.tail_types[cls] + 1)
        return np.log(seen / (self.tail_total[cls] + 1))


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % gru.TAIL


#: Contexts of two and of three bytes are hashed into this many rows; a row's counts weigh against KAPPA of the shorter context.
CONTEXTS, KAPPA, PAIR_SMOOTHING = (2048, 8192), 2.0, 0.1
_MARK = 256  # what stands before a word's first byte
_SHAPES = ((256, 257), (257, 257), (CONTEXTS[0], 257), (CONTEXTS[1], 257))
_SIZES = [a * b for a, b in _SHAPES]


def _spelled(words: list[bytes]):
    """Of the words' bytes from their ends, with the mark: places of last pairs and of later bytes in the tables, and the later bytes' places."""
    points = np.full(sum(map(len, words)) + len(words) + 1, _MARK, np.int64)
    inside = np.repeat(True, len(points))
    ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64)
    inside[np.concatenate([[0], ends])] = False
    points[inside] = np.frombuffer(b"".join(words), np.uint8)
    points = points[::-1]  # the last word comes first, from its end to the mark before it
    start = np.flatnonzero(points[:-1] == _MARK) + 1  # last bytes
    later = np.ones(len(points), bool)
    later[0], later[start], later[start + 1] = False, False, False
    at = np.flatnonzero(later)
    a, b, c, x = points[at - 1], points[at - 2], points[at - 3], points[at]
    two = (a * 0x9E3779B1 + b * 0x85EBCA77 >> 7) % CONTEXTS[0]
    three = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D >> 9) % CONTEXTS[1]
    return points[start] * 257 + points[start + 1], (a, two, three), x, start, at


def spelling_counts(words: list[bytes]) -> np.ndarray:
    """All tables end to end: pairs of a last byte and the one before, and bytes by the one, two and three bytes after them."""
    pair, contexts, x, _, _ = _spelled(words)
    cells = [pair, *(k * 257 + x for k in contexts)]
    return np.concatenate([np.bincount(c, minlength=n) for c, n in zip(cells, _SIZES, strict=True)])


class Speller:
    """P(word | its class, a word never seen), from ``spelling_counts``."""

    def __init__(self, counts: np.ndarray):
        tables = [t.reshape(s).astype(np.float32) for t, s in zip(np.split(counts, np.cumsum(_SIZES)[:-1]), _SHAPES, strict=True)]
        pairs = tables[0].astype(np.float64) + PAIR_SMOOTHING
        cls = np.array([[word_class(bytes([b, a]) if b != _MARK else bytes([a])) for b in range(257)] for a in range(256)])
        self.log_pair = np.log(pairs / np.bincount(cls.ravel(), pairs.ravel(), gru.TAIL)[cls]).ravel()
        self.tables = tables[1:]
        self.totals = [t.sum(1, dtype=np.float64) for t in self.tables]

    def log_probs(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        pair, contexts, x, start, at = _spelled(words)
        p = np.full(len(x), 1 / 257)
        for rows, table, total in zip(contexts, self.tables, self.totals, strict=True):
            p = (table[rows, x] + KAPPA * p) / (total[rows] + KAPPA)
        each = np.zeros(int(start[-1]) + len(words[0]) + 1)
        each[at], each[start] = np.log(p), self.log_pair[pair]
        return np.add.reduceat(each, start)[::-1]


_PIECE_WORDS = 100_000


def _count_spellings(batches):
    total, held, rows = np.zeros(sum(_SIZES), np.int64), [], 0
    for batch in batches:
        held += batch.column("word").to_pylist()
        if len(held) >= _PIECE_WORDS:
            total += spelling_counts(held)
            held = []
        rows += batch.num_rows
    if held:
        total += spelling_counts(held)
    if rows:
        yield pa.record_batch([pa.array([TaskContext.get().partitionId() % 64], pa.int32()), pa.array([packed(total)], pa.binary())], ["part", "counts"])


def _add_spellings(key, table):
    total = np.zeros(sum(_SIZES), np.int64)
    for x in table.column("counts"):
        total += unpacked(x.as_py())
    return pa.table({"part": pa.array([0], pa.int32()), "counts": pa.array([packed(total)], pa.binary())})


def fit_speller(words: DataFrame) -> Speller:
    """From all of ``words`` (word binary): tables of fixed size, summed in two steps."""
    made = "part int, counts binary"
    summed = words.select("word").mapInArrow(_count_spellings, made).groupBy("part").applyInArrow(_add_spellings, made).groupBy("part").applyInArrow(_add_spellings, made)
    found = summed.collect()  # at most one row
    return Speller(unpacked(found[0].counts) if found else np.zeros(sum(_SIZES), np.int64))


def _gather(batches):
    """Codes packed by block: in a task's order, at most GATHER_ROWS at once."""
    held: list = []
    rows = 0

    def flush():
        block, local, code, c = (np.concatenate([h[k] for h in held]) for k in range(4))
        words = [w for h in held for w in h[4]]
        order = np.argsort(block, kind="stable")
        block = block[order]
        edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
        cols: list[list] = [[] for _ in range(6)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = order[a:b]
            own = own[np.argsort(local[own], kind="stable")]
            lost = own[c[own] == 0]
            for col, v in zip(cols, (int(block[a]), packed(local[own]), packed(code[own]), packed(c[own]), local[lost], [words[i] for i in lost]), strict=True):
                col.append(v)
        held.clear()
        types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary())]
        return pa.record_batch([pa.array(x, t) for x, t in zip(cols, types, strict=True)], ["block", "locals", "codes", "counts", "unseen", "words"])

    for batch in batches:
        held.append((*(batch.column(c).to_numpy() for c in ("block", "local", "code", "c")), batch.column("word").to_pylist()))
        rows += batch.num_rows
        if rows >= GATHER_ROWS:
            yield flush()
            rows = 0
    if rows:
        yield flush()


def _assemble(key, tokens, codes):
    """One row for a block: its documents, and code and count by local number."""
    parts = [[unpacked(x) for x in codes.column(c).to_pylist()] for c in ("locals", "codes", "counts")]
    local, code, c = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in parts)
    order = np.argsort(local)
    unseen = [i for x in codes.column("unseen").to_pylist() for i in x]
    words = [w for x in codes.column("words").to_pylist() for w in x]
    values = (key[0].as_py(), tokens.column("id").to_pylist(), tokens.column("held").to_pylist(), tokens.column("ids").to_pylist(), packed(code[order]), packed(c[order]), unseen, words)
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary())]
    return pa.table([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["block", "id", "held", "ids", "codes", "counts", "unseen", "words"])


def _documents(row: dict):
    """Of a block's row: held flags, lengths and all local numbers of its documents, and the code of each local number."""
    ids = [unpacked(x) for x in row["ids"]]
    return np.array(row["held"], bool), np.array([len(x) for x in ids], np.int64), np.concatenate(ids), unpacked(row["codes"]).astype(np.int64)


def _weights_out(flat: np.ndarray, part: int, weight: float):
    pieces = [flat[a : a + CHUNK].astype(np.float64) * weight for a in range(0, len(flat), CHUNK)]
    n = len(pieces)
    return pa.table({"chunk": pa.array(range(n), pa.int32()), "part": pa.array([part] * n, pa.int32()), "weight": pa.array([weight] * n, pa.float64()), "total": pa.array([x.tobytes() for x in pieces], pa.binary())})


def _train(held_weights, rate: float, passes: int, most: int | None = None):
    """Train on the training documents of each block; ``most``: on the first of them, up to this many tokens and one document."""

    def train(batches):
        gru.one_thread()
        for batch in batches:
            for row in batch.to_pylist():
                held, lengths, ids, code = _documents(row)
                if most is not None:
                    held = held | (np.cumsum(np.where(held, 0, lengths)) - np.where(held, 0, lengths) >= most)
                use = np.repeat(~held, lengths)
                flat = gru.train(held_weights.value, code[ids[use]], lengths[~held], rate, passes)
                yield from _weights_out(flat, row["block"] % 64, float(use.sum())).to_batches()

    return train


def _sum_parts(key, table):
    total = np.zeros(CHUNK)
    for x in table.column("total").to_pylist():
        v = np.frombuffer(x)
        total[: len(v)] += v
    size = len(np.frombuffer(table.column("total")[0].as_py()))
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "weight": pa.array([sum(table.column("weight").to_pylist())], pa.float64()), "total": pa.array([total[:size].tobytes()], pa.binary())})


def _average(parts: DataFrame, fallback: np.ndarray) -> np.ndarray:
    summed = parts.groupBy("chunk", "part").applyInArrow(_sum_parts, _PARTS).groupBy("chunk").applyInArrow(_sum_parts, _PARTS)
    rows = sorted(summed.collect(), key=lambda r: r.chunk)  # SIZE / CHUNK rows
    if not rows or any(not r.weight for r in rows):
        return fallback
    return np.concatenate([np.frombuffer(r.total) / r.weight for r in rows]).astype(np.float32)


def _score(held_model):
    def score(batches):
        gru.one_thread()
        model = held_model.value
        for batch in batches:
            for row in batch.to_pylist():
                held, lengths, ids, code = _documents(row)
                c = unpacked(row["counts"]).astype(np.int64)
                base = np.log10((c + 1) / (model.corpus.n + model.corpus.v + 1))
                tail = np.where(code >= gru.HEAD, model.corpus.tail_log(np.maximum(code - gru.HEAD, 0), c), 0.0)
                tail[row["unseen"]] += model.speller.log_probs(row["words"])
                lp = gru.log_likelihood(model.weights, code[ids], lengths) + tail[ids]
                at = np.cumsum(lengths) - lengths  # every document has its end token
                yield pa.record_batch(
                    [
                        pa.array(row["id"], pa.int64()), pa.array(held, pa.bool_()), pa.array(lengths, pa.int64()), pa.array(np.add.reduceat((c > 0).astype(np.int64)[ids], at), pa.int64()),
                        pa.array([model.corpus.n] * len(lengths), pa.int64()), pa.array(np.add.reduceat(base[ids], at), pa.float64()), pa.array(np.add.reduceat(lp, at) / np.log(10), pa.float64()),
                    ],
                    ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return score


class LanguageModel:
    """Weights, corpus counts, head words and spelling: all of fixed size."""

    def __init__(self, weights: np.ndarray, corpus: CorpusCounts, head_words: list[bytes], speller: Speller):
        self.weights, self.corpus, self.head_words, self.speller = weights, corpus, head_words, speller


def coded_words(vocab: DataFrame) -> DataFrame:
    """``vocab`` (block, local, word, c, cls, common) as ``block, local, word, cls, n, lead``: a word's training count, and one row of each word marked."""
    short = F.octet_length("word") <= COMMON_BYTES
    common = vocab.where(F.col("common") & short).groupBy("word").agg(F.count("*").alias("blocks")).orderBy(F.col("blocks").desc(), "word").limit(COMMON_WORDS)
    common = staged(common.select("word"), "lm-common")
    summed = vocab.join(F.broadcast(common), "word", "left_semi").groupBy("word").agg(F.sum("c").alias("n"), F.min(F.struct("block", "local")).alias("at"))
    summed = staged(summed, "lm-common-counts")
    here = vocab.join(F.broadcast(summed), "word").select("block", "local", "word", "cls", "n", (F.struct("block", "local") == F.col("at")).alias("lead"))
    # A block names a word once, and what is left are words that few blocks have: one exchange by word serves.
    of_word = Window.partitionBy("word")
    first = F.row_number().over(of_word.orderBy("block", "local")) == 1
    rest = vocab.join(F.broadcast(common), "word", "left_anti").select("block", "local", "word", "cls", F.sum("c").over(of_word).alias("n"), first.alias("lead"))
    return here.unionByName(rest)


def fit_language_model(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", seed_passes: int = SEED_PASSES) -> tuple[LanguageModel, DataFrame]:
    """The model and the coded blocks of all documents; ``held_out``: condition on the column ``id``."""
    spark = docs.sparkSession
    rows = text_rows(docs, id_col, text_col).withColumn("held", F.coalesce(held_out, F.lit(True)))
    made = staged(rows.mapInArrow(_tokenise(), _TOKENS), "lm-tokens")
    tokens = made.where("ids is not null").select("block", "id", "held", "ids")
    vocab = made.where("word is not null").select("block", "local", "word", "c", "cls", "common")
    every = staged(coded_words(vocab), "lm-words")
    counts = every.where("lead").select("word", F.col("n").alias("c"), "cls")
    total = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # The head: a fixed number of words of bounded size.
    short = (F.col("c") > 0) & (F.col("word") != F.lit(END_WORD)) & (F.octet_length("word") <= COMMON_BYTES)
    head = counts.where(short).orderBy(F.col("c").desc(), "word").limit(gru.HEAD - 1).select("word", "c").collect()
    end = counts.where(F.col("word") == F.lit(END_WORD)).select("c").first()
    head_words = [(END_WORD, end.c if end else 0), *((bytes(r.word), r.c) for r in head)]
    heads = spark.createDataFrame([(bytearray(w), i) for i, (w, _) in enumerate(head_words)], "word binary, head int")
    outside = counts.join(F.broadcast(heads), "word", "left_anti").where("c > 0")
    tail = outside.groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("types")).collect()
    corpus = CorpusCounts(int(total[0]), int(total[1]), head_words, [(r.cls, r.c, r.types) for r in tail])
    speller = fit_speller(outside)
    code = F.coalesce("head", F.col("cls") + gru.HEAD).cast("int").alias("code")
    codes = every.join(F.broadcast(heads), "word", "left").select("block", "local", code, F.col("n").alias("c"), F.when(F.col("n") == 0, F.col("word")).alias("word"))
    gathered = codes.mapInArrow(_gather, _CODES).withColumnRenamed("block", "vblock")
    blocks = staged(tokens.groupBy("block").cogroup(gathered.groupBy("vblock")).applyInArrow(_assemble, _BLOCK), "lm-blocks")
    learned = blocks.where(F.exists("held", lambda h: ~h)).select("block", "held", "ids", "codes")
    weights = gru.initial(corpus.head_counts, corpus.tail_total)
    first = learned.agg(F.min("block")).first()[0]
    if first is not None:
        start = spark.sparkContext.broadcast(weights)
        weights = _average(learned.where(F.col("block") == first).mapInArrow(_train(start, SEED_RATE, seed_passes, SEED_TOKENS), _PARTS), weights)
        start = spark.sparkContext.broadcast(weights)
        weights = _average(learned.mapInArrow(_train(start, RATE, 1), _PARTS), weights)
    return LanguageModel(weights, corpus, [w for w, _ in head_words], speller), blocks


def score_documents(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", seed_passes: int = SEED_PASSES) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score``; ``held_out``: condition on the column ``id``."""
    model, blocks = fit_language_model(docs, held_out, id_col, text_col, seed_passes)
    return blocks.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_gru_language_model(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, crc_mod("id", 7) == 2).withColumnRenamed("id", "doc_id")
