"""Scoring by a smoothed trigram model as a weighted backoff automaton.

The model. Words are maximal runs of characters other than ASCII white space, with A-Z
lower-cased; a text is its words and one end. Counts come from the training documents only. The
root's probability of a word is (c + 0.5) / (N + 0.5 (V + 1)), which leaves an equal share for any
word never seen. A history h of one or two tokens that training shows (the start of a text counts
as one) has p(w | h) = (c(h w) + M p(w | h')) / (c(h) + M), where h' is h without its first token
(Dirichlet smoothing, so each state's probabilities sum to one).

The automaton. Its states are the root and those histories. A state has an arc for every token that
training shows after it, which carries the log-probability and leads to the state of the longest
known history that then stands; and a failure arc of weight M / (c(h) + M) to the state of h'. A
text is read once from left to right: while the state has no arc for the token its failure arc is
taken, at the root every token has an arc, and the logarithms add up.

The work. The automaton grows with the corpus, so no task holds it whole. Texts are cut into blocks
of bounded size, written as files of word numbers. A block sends the sorted keys of its distinct
words, bigrams and trigrams with its counts, packed by key range; each range is summed over the
blocks and every block gets back the totals of its own keys, which are just the states and arcs that
its texts can meet. Any word, however frequent, is one number a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from penumbra.llm.common import GOLDEN, materialise, mix64, open_fs, shared_folder, shuffle_partitions, slices, text_or_empty, words_of

#: The Dirichlet weights M of histories of one and of two tokens.
WEIGHTS = (50.0, 20.0)
#: Bytes of text in a block, and tokens of the corpus to a key range.
BLOCK_BYTES, RANGE_TOKENS = 6 << 20, 1_000_000
#: Tokens that the automaton reads of one text in a stretch; stretches advance side by side.
STRETCH = 1024
#: Bits by which n-gram keys are longer than the number of tokens: a key meets another by chance once in 2**20.
KEY_BITS = 20
#: Keys of the end of a text and of the state before its first word; no word hashes to them but by chance.
END_KEY, START_KEY = 0x454E44, 0x5354415254
#: Kinds of n-grams.
WORDS, BIGRAMS, TRIGRAMS = 0, 1, 2

_SENT = "block long, kind int, part int, keys binary, counts binary"
_TOTALS = "block long, kind int, part int, totals binary, seen long"


def _shrink(values: np.ndarray) -> bytes:
    """Numbers as zstandard over byte planes: the high planes of small numbers shrink away."""
    v = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=1).compress(v.view(np.uint8).reshape(len(v), v.itemsize).T.tobytes())


def _grow(data: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _shrink(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_grow(data, "<u8"), dtype=np.uint64)


class Block:
    """Texts as word numbers. ``keys`` are the distinct words' keys in ascending order, ``tokens`` the texts' word
    numbers with an end after each text, ``lengths`` their tokens."""

    def __init__(self, ids: list, train: list, lengths: np.ndarray, keys: np.ndarray, tokens: np.ndarray):
        self.ids, self.train, self.lengths, self.keys, self.tokens = ids, train, lengths, keys, tokens
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.end = int(np.searchsorted(keys, np.uint64(END_KEY)))

    @classmethod
    def of(cls, ids: list, train: list, texts: pa.Array) -> Block:
        words, order, bounds = words_of(texts)
        hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))
        keys, number = np.unique(np.append(hashed, np.uint64(END_KEY)), return_inverse=True)
        lengths = np.diff(bounds) + 1
        tokens = np.full(int(lengths.sum()), number[-1], np.int32)
        shown = np.ones(len(tokens), bool)
        shown[np.cumsum(lengths) - 1] = False
        tokens[shown] = number[:-1][order]
        return cls(ids, train, lengths, keys, tokens)

    def write(self, stream) -> None:
        row = {
            "ids": pa.array([self.ids], pa.list_(pa.int64())),
            "train": pa.array([self.train], pa.list_(pa.bool_())),
            "lengths": pa.array([self.lengths.tolist()], pa.list_(pa.int64())),
            "keys": pa.array([_pack_keys(self.keys)], pa.large_binary()),
            "tokens": pa.array([_shrink(self.tokens.astype("<i4"))], pa.large_binary()),
        }
        table = pa.table(row)
        with pa.ipc.new_stream(stream, table.schema) as out:
            out.write_table(table)

    @classmethod
    def read(cls, folder: str, block: int) -> Block:
        fs, root = open_fs(folder)
        with fs.open_input_stream(f"{root}/block-{block}") as f:
            (row,) = pa.ipc.open_stream(f).read_all().to_pylist()
        return cls(row["ids"], row["train"], np.array(row["lengths"], np.int64), _unpack_keys(row["keys"]), _grow(row["tokens"], "<i4"))

    def bigrams(self) -> np.ndarray:
        """The key of every token with the one before it, or with the start."""
        word = self.keys[self.tokens]
        before = np.empty(len(word), np.uint64)
        before[1:] = word[:-1]
        before[self.starts] = np.uint64(START_KEY)
        with np.errstate(over="ignore"):
            return mix64(before * np.uint64(GOLDEN) + word)

    def trigrams(self, bigrams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of tokens that are not the first of a text, and the key of each with the bigram before it."""
        later = np.ones(len(self.tokens), bool)
        later[self.starts] = False
        at = np.flatnonzero(later)
        with np.errstate(over="ignore"):
            return at, mix64(bigrams[at - 1] * np.uint64(GOLDEN) + self.keys[self.tokens[at]] + np.uint64(1))


def _write_blocks(folder: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Files are named by the attempt: whatever a lost one left behind is never read.
        fs, root = open_fs(folder)
        number = TaskContext.get().taskAttemptId() << 24
        for batch in batches:
            for part in slices(batch, size=block_bytes):
                block = Block.of(part.column("doc_id").to_pylist(), part.column("train").to_pylist(), part.column("text"))
                fs.create_dir(root, recursive=True)
                with fs.open_output_stream(f"{root}/block-{number}") as out:
                    block.write(out)
                count = int(block.lengths[np.array(block.train, bool)].sum())
                yield pa.RecordBatch.from_pydict({"block": [number], "tokens": [len(block.tokens)], "train_tokens": [count], "documents": [sum(block.train)]})
                number += 1

    return run


def _ranged(kind: int, keys: np.ndarray, counts: np.ndarray, ranges: int, spare: int) -> Iterator[tuple]:
    """Sorted keys cut into equal ranges of the key space, without their ``spare`` low bits."""
    edges = np.searchsorted(_part(keys, ranges), np.arange(ranges + 1))
    for p in np.flatnonzero(np.diff(edges)).tolist():
        lo, hi = edges[p], edges[p + 1]
        yield kind, p, _pack_keys(keys[lo:hi] >> np.uint64(spare)), _shrink(counts[lo:hi].astype("<u4"))


def _part(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _cleared(keys: np.ndarray, spare: int) -> np.ndarray:
    return keys >> np.uint64(spare) << np.uint64(spare)


def _counted(folder: str, kinds: tuple[int, ...], ranges: int, spare: int):
    names, types = ["block", "kind", "part", "keys", "counts"], [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def grams(block: Block) -> Iterator[tuple]:
        train = np.repeat(np.array(block.train, bool), block.lengths)
        if WORDS in kinds:
            yield from _ranged(WORDS, block.keys, np.bincount(block.tokens[train], minlength=len(block.keys)), ranges, 0)
        if BIGRAMS in kinds:
            pairs = block.bigrams()
            at, triples = block.trigrams(pairs)
            for kind, keys, weights in ((BIGRAMS, pairs, train), (TRIGRAMS, triples, train[at])):
                distinct, where = np.unique(_cleared(keys, spare), return_inverse=True)
                yield from _ranged(kind, distinct, np.bincount(where, weights, len(distinct)), ranges, spare)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (n for batch in batches for n in batch.column("block").to_pylist()):
            rows = [(number, *row) for row in grams(Block.read(folder, number))]
            for at in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 256], strict=True), types, strict=True)], names)

    return run


def _sum(table: pa.Table) -> pa.Table:
    """Totals over blocks of one range of one kind, for each block in the order of its keys."""
    keys = [_unpack_keys(k) for k in table.column("keys").to_pylist()]
    counts = np.concatenate([_grow(c, "<u4") for c in table.column("counts").to_pylist()])
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(where, weights=counts, minlength=len(distinct)).astype(np.int64)
    mine = np.split(totals[where], np.cumsum([len(k) for k in keys])[:-1])
    seen = np.zeros(len(keys), np.int64)
    seen[0] = int((totals > 0).sum())
    return pa.table(
        {
            "block": table.column("block"),
            "kind": table.column("kind"),
            "part": table.column("part"),
            "totals": pa.array([_shrink(t.astype("<i8")) for t in mine], pa.binary()),
            "seen": seen,
        }
    )


class Automaton:
    """The states and arcs that a block's texts can meet.

    States: 0 the root, 1 + w the word w, 1 + W the start, then a state for each distinct bigram. States
    without a count are never entered.
    """

    def __init__(self, block: Block, totals: dict[int, np.ndarray], tokens: int, types: int, documents: int, weights: tuple[float, float], spare: int):
        one, two = weights
        size, sequence = len(block.keys), block.tokens.astype(np.int64)
        self.size, self.start = size, 1 + size
        words = totals[WORDS]
        p_word = (words + 0.5) / (tokens + 0.5 * (types + 1))
        self.root_log, self.root_to = np.log10(p_word), np.where(words > 0, 1 + np.arange(size), 0)
        pairs = block.bigrams()
        at, triples = block.trigrams(pairs)
        _, first, pair = np.unique(_cleared(pairs, spare), return_index=True, return_inverse=True)
        _, first3 = np.unique(_cleared(triples, spare), return_index=True)
        base = 2 + size
        #: Of each bigram: the state of its first token, its second token, the count of the first, and its probability.
        before = np.empty(len(sequence), np.int64)
        before[1:] = 1 + sequence[:-1]
        before[block.starts] = self.start
        state, token = before[first], sequence[first]
        held = np.append(np.append(0, words), documents)[state]
        count = totals[BIGRAMS]
        p_pair = (count + one * p_word[token]) / (held + one)
        to = np.where(token == block.end, 0, base + np.arange(len(first)))
        #: Of each trigram: the bigram that is its history, and the bigram of its last two tokens.
        place = at[first3]
        history, last = pair[place - 1], pair[place]
        held3, count3 = count[history], totals[TRIGRAMS]
        p_triple = (count3 + two * p_pair[last]) / (held3 + two)
        known, known3 = count > 0, count3 > 0
        keys = np.concatenate([(state * size + token)[known], ((base + history) * size + token[last])[known3]])
        order = np.argsort(keys)
        self.arcs = keys[order]
        self.arc_log = np.log10(np.concatenate([p_pair[known], p_triple[known3]]))[order]
        self.arc_to = np.concatenate([to[known], to[last][known3]])[order]
        contexts = np.append(np.append(0, words), documents)
        self.fail_log = np.concatenate([np.log10(one / (contexts + one)), np.log10(two / (count + two))])
        self.fail_to = np.concatenate([np.zeros(base, np.int64), 1 + token])

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states of some texts that read a token each, and the log-probabilities of the moves."""
        state, log = state.copy(), np.zeros(len(state))
        following = np.empty(len(state), np.int64)
        todo = np.arange(len(state))
        while len(todo):
            here, read = state[todo], token[todo]
            root = here == 0
            at_root = todo[root]
            log[at_root] += self.root_log[read[root]]
            following[at_root] = self.root_to[read[root]]
            todo, here, read = todo[~root], here[~root], read[~root]
            if not len(todo):
                break
            key = here * self.size + read
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1) if len(self.arcs) else np.zeros(len(key), np.int64)
            hit = self.arcs[arc] == key if len(self.arcs) else np.zeros(len(key), bool)
            log[todo[hit]] += self.arc_log[arc[hit]]
            following[todo[hit]] = self.arc_to[arc[hit]]
            todo, here = todo[~hit], here[~hit]
            log[todo] += self.fail_log[here]
            state[todo] = self.fail_to[here]
        return following, log

    def read(self, tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray, stretch: int = STRETCH) -> np.ndarray:
        """Log-probabilities of texts, each read from left to right by carrying its state.

        Texts advance side by side. A long text is read in stretches that also advance side by side: a
        stretch first reads the two tokens before it from the root without counting them, after which its
        state is the one that the whole text would have there, because no state remembers more.
        """
        pieces = np.maximum(1, -(-lengths // stretch))
        owner = np.repeat(np.arange(len(lengths)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        warm = np.where(number > 0, 2, 0)
        begin = starts[owner] + number * stretch - warm
        count = np.minimum(lengths[owner] - number * stretch, stretch) + warm
        order = np.argsort(-count, kind="stable")
        owner, warm, begin, count, number = owner[order], warm[order], begin[order], count[order], number[order]
        state, total = np.where(number > 0, 0, self.start), np.zeros(len(owner))
        alive = np.searchsorted(-count, -np.arange(int(count.max(initial=0))), "left")
        for i, n in enumerate(alive.tolist()):
            state[:n], log = self.step(state[:n], tokens[begin[:n] + i])
            total[:n] += log if i >= 2 else np.where(i >= warm[:n], log, 0.0)
        return np.bincount(owner, total, len(lengths))


def _score(folder: str, tokens: int, types: int, documents: int, weights: tuple[float, float], spare: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        totals = {kind: [_grow(r["totals"], "<i8") for r in rows if r["kind"] == kind] for kind in (WORDS, BIGRAMS, TRIGRAMS)}
        totals = {kind: np.concatenate(parts) if parts else np.empty(0, np.int64) for kind, parts in totals.items()}
        block = Block.read(folder, rows[0]["block"])
        automaton = Automaton(block, totals, tokens, types, documents, weights, spare)
        known = (totals[WORDS][block.tokens] > 0).astype(np.int64)
        return pa.table(
            {
                "doc_id": pa.array(block.ids, pa.int64()),
                "held_out": pa.array([not t for t in block.train], pa.bool_()),
                "n_tokens": block.lengths,
                "n_known": np.add.reduceat(known, block.starts),
                "train_tokens": np.full(len(block.lengths), tokens, np.int64),
                "base_score": np.add.reduceat(automaton.root_log[block.tokens], block.starts),
                "score": automaton.read(block.tokens, block.starts, block.lengths),
            }
        )

    return run


def trained_on(id_col: Column) -> Column:
    """Documents to learn from: crc32 of the id's text doesn't leave 1 by division by 5."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 != 1, F.lit(True))


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    weights: tuple[float, float] = WEIGHTS,
    block_bytes: int = BLOCK_BYTES,
    range_tokens: int = RANGE_TOKENS,
) -> DataFrame:
    """Every document's log10 probability.

    Returns ``doc_id``, ``held_out``, ``n_tokens`` (words and the end), ``n_known`` (tokens that
    training has), ``train_tokens``, ``base_score`` (under the root alone) and ``score`` (under the
    automaton). Null text counts as empty: its only token is the end. A null id counts as a
    training row; repeated rows count and are answered each; other columns are ignored; an empty
    table gives an empty table. A text longer than a block is a block by itself. Words are known by
    64-bit hashes (n distinct words share one about n * n / 2**65 times); n-gram keys have KEY_BITS
    more bits than the number of tokens, so about one in a million meets another, and then their
    counts add.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), trained_on(F.col(id_col)).alias("train"), text_or_empty(text_col).alias("text"))
    folder = shared_folder(spark, "blocks")
    blocks = materialise(rows.mapInArrow(_write_blocks(folder, block_bytes), "block long, tokens long, train_tokens long, documents long"), "manifest")
    size = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "train_tokens", "documents"))).first()
    ranges = max(16, -(-size["tokens"] // range_tokens))
    spare = max(0, 64 - max(32, size["tokens"].bit_length() + KEY_BITS))
    spread = blocks.select("block").repartition(max(shuffle_partitions(spark), 1), "block")
    words = spread.mapInArrow(_counted(folder, (WORDS,), ranges, spare), _SENT).groupBy("kind", "part").applyInArrow(_sum, _TOTALS)
    words = materialise(words, "totals")
    types = words.agg(F.sum("seen")).first()[0] or 0
    grams = spread.mapInArrow(_counted(folder, (BIGRAMS, TRIGRAMS), ranges, spare), _SENT).groupBy("kind", "part").applyInArrow(_sum, _TOTALS)
    back = words.union(grams).select("block", "kind", "part", "totals")
    return back.groupBy("block").applyInArrow(
        _score(folder, size["train_tokens"], int(types), size["documents"], weights, spare),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
