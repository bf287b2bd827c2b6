"""Language-model scoring with a hierarchical Pitman-Yor process of two levels.

Every word (and the start of a text) is a context restaurant whose customers
are the words that follow it in training texts; all share the root restaurant
as parent, whose customers are the context restaurants' tables, over a
uniform base. Given how the customers sit, the next word's probability in
context u is

    (c_uw - d t_uw + (theta + d t_u) P(w)) / (theta + c_u)

with customers c and tables t, and P(w) the same formula at the root.

Seating. Gibbs sweeps draw the number of tables t_uw of every dish of every
restaurant from its conditional given the other dishes' tables and the root:
proportional to the generalised Stirling number S_d(c, t) times the chance
that t tables open: from all numbers of tables for up to ``exact`` customers,
from the first ``exact`` numbers where more are out of reach, and from a normal
distribution around the mode otherwise (dishes of some 20 tables and more; see
``_large``). Dishes with one customer have one table. The root's tables are
drawn in the same way, given the sum of all words' root tables of the sweep
before, if ``root_given``. The first sweep starts from tables as a power of the customers and
the words' frequencies. The draws use uniforms that are a hash of (bigram,
sweep), so any task draws the same tables for a bigram without asking. After
each sweep the tables are summed per context and per word over the corpus;
probabilities are averaged over the sweeps behind ``burn_in``.

Scale. Each task cuts its documents into chunks and turns their texts into word
numbers once; a chunk crosses to its place once, as its words' keys and those
numbers, and is read from there in every sweep. Distinct words of a
chunk ask for their training counts, its distinct bigrams for theirs (the
first chunk that holds a bigram in training is told that it counts it), and
each sweep's sums go the same way (see ``exchange``); all counts come from the whole training
corpus and grow with it, and no table is held by the driver or broadcast. A
common word sends one key per chunk. Every chunk asks every shard, so it hears every shard's totals.
Answers of all sweeps are dealt by chunk as the chunks are, so none is shuffled again for a later sweep.

Null or empty text: the end token alone. A null id counts as the text ''.
Repeated rows count and are scored as often as they come; without training
texts the score is the uniform one over the single type end. An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame

from agora.llm.common import byte_slices, id_text, prepare
from agora.llm.exchange import chunk_count, cuts, pack, unpack

SCHEMA = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")
START, END = (xxhash.xxh64_intdigest(x, 1) for x in (b"start", b"end"))


@dataclass(frozen=True)
class Settings:
    discount: float = 0.75
    strength: float = 1.0
    root_discount: float = 0.8
    root_strength: float = 10.0
    sweeps: int = 3
    burn_in: int = 1
    exact: int = 64
    root_given: bool = False    # root tables given the root's other tables, not with a constant weight
    add_one: bool = False       # base scores by (c+1) / (N+V+1), a type kept for unseen tokens, not (c+1) / ((N+1)(V+1))
    bigram_bits: int = 48       # of a bigram's key; words have 64
    chunk_bytes: int = 8 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, ASCII letters lower-cased, coded by their distinct values, and each text's number of words.

    Arrow's ASCII white space is \\x20 and \\x09 to \\x0D."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, sizes = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    some = pc.not_equal(words, "").to_numpy(zero_copy_only=False)  # white space at an end leaves an empty string
    if not some.all():
        row = np.repeat(np.arange(len(sizes)), sizes)
        words, sizes = words.filter(pa.array(some)), np.bincount(row[some], minlength=len(sizes))
    return words.dictionary_encode(), sizes


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a position of each, and every position's index among them."""
    order = np.argsort(keys)
    key = keys[order]
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    index = np.empty(len(key), np.int64)
    index[order] = np.cumsum(new) - 1
    return key[new], order[new], index


def bigram_keys(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """Keys of pairs of word keys."""
    return mix(left * np.uint64(3) + right) & np.uint64((1 << 64) - (1 << 64 - bits))


def is_held_out(doc_id: int | None, mod: int, rest: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod == rest


STATE = "chunk long, ids array<long>, sizes binary, words binary, target binary"
STATE_OUT = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("words", pa.binary()),
                       ("target", pa.binary())])


def parsed(documents: DataFrame, chunk_bytes: int) -> DataFrame:
    """A row (STATE) per chunk of about ``chunk_bytes`` bytes of text: its ids, tokens by text, the sorted
    keys of its distinct words, the end and the start, and the tokens as positions among them. Chunks are cut within a task's rows."""
    def run(batches):
        first, n, waiting, size = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            for piece in byte_slices(batch, "text", max(chunk_bytes - size, 1)):
                waiting.append(piece)
                size += pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0
                if size >= chunk_bytes:
                    yield _state(first + n, waiting)
                    n, waiting, size = n + 1, [], 0
        if waiting:
            yield _state(first + n, waiting)
    return documents.mapInArrow(run, STATE)


def _state(number: int, pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(pieces).combine_chunks()
    coded, sizes = words_of(pa.concat_arrays(table["text"].chunks))
    names = coded.dictionary.cast(pa.binary()).to_pylist()
    keys = mix(np.fromiter((*map(xxhash.xxh64_intdigest, names), START, END), np.uint64, len(names) + 2))
    order = np.argsort(keys)
    rank = np.empty(len(keys), np.uint32)
    rank[order] = np.arange(len(keys), dtype=np.uint32)
    ends = np.cumsum(sizes + 1) - 1
    target = np.full(int((sizes + 1).sum()), rank[-1])
    is_word = np.ones(len(target), bool)
    is_word[ends] = False
    target[is_word] = rank[coded.indices.to_numpy()]
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.array([table["doc_id"].to_pylist()], pa.list_(pa.int64())),
         *(pa.array([x], pa.binary()) for x in (pack((sizes + 1).astype(np.uint64)), pack(keys[order], True), pack(target)))],
        schema=STATE_OUT)


class Chunk:
    """A chunk's tokens as indices of its distinct words and bigrams."""

    def __init__(self, state: pa.Table, mod: int, rest: int, bits: int):
        self.ids = state["ids"][0].as_py()
        self.words, self.target, self.sizes = (unpack(state[c][0].as_py(), kind, c == "words") for c, kind in
                                               (("words", np.uint64), ("target", np.uint32), ("sizes", np.uint64)))
        self.target, self.sizes = self.target.astype(np.int64), self.sizes.astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.held_out = np.array([is_held_out(i, mod, rest) for i in self.ids], bool)
        self.start = int(np.searchsorted(self.words, mix(np.array([START], np.uint64)))[0])
        self.context = np.empty_like(self.target)
        self.context[1:] = self.target[:-1]
        self.context[self.starts] = self.start
        self.bigrams, at, self.bigram = distinct(bigram_keys(self.words[self.context], self.words[self.target], bits))
        self.left, self.right = self.context[at], self.target[at]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of the words, texts for the start, and of the bigrams."""
        training = np.repeat(~self.held_out, self.sizes)
        of_word = np.bincount(self.target[training], minlength=len(self.words))
        of_word[self.start] = (~self.held_out).sum()
        return of_word, np.bincount(self.bigram[training], minlength=len(self.bigrams))


QUESTION = "shard int, kind int, chunk long, keys binary, x binary, y binary, z binary, a long, b long"
ANSWER = "shard int, kind int, chunk long, x binary, y binary, z binary, a long, b long"
QUESTION_NAMES = [c.split(" ")[0] for c in QUESTION.split(", ")]
ANSWER_NAMES = [c.split(" ")[0] for c in ANSWER.split(", ")]
WORD, BIGRAM, SWEEP = 0, 1, 2    # sweep s has kind SWEEP + s
_KIND = {"keys": pa.binary(), "x": pa.binary(), "y": pa.binary(), "z": pa.binary(), "a": pa.int64(), "b": pa.int64(),
         "chunk": pa.int64()}


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.table({n: pa.array(c, _KIND.get(n, pa.int32())) for n, c in zip(names, columns)})


def _ask(kind: int, chunk: int, shards: int, keys: np.ndarray, x: np.ndarray, y: np.ndarray | None = None,
         z: np.ndarray | None = None, a: int | None = None, b: int | None = None) -> pa.Table:
    ends, out = cuts(keys, shards), []
    packed = lambda v, i, j: None if v is None else pack(v[i:j].astype(np.uint64))
    for shard in range(shards):
        i, j = ends[shard], ends[shard + 1]
        out.append((shard, kind, chunk, pack(keys[i:j], True), packed(x, i, j), packed(y, i, j), packed(z, i, j), a, b))
    return _table(out, QUESTION_NAMES)


def _reply(table: pa.Table, s: Settings) -> pa.Table:
    """Sums over the chunks' questions of one shard, in the order of each chunk's keys.

    Words: x the training count. Bigrams: x twice the training count, plus 1
    for the first chunk that has it in training. Sweeps: x the tables of a
    context, y those of a word (with z a word's root tables of the sweep before, a
    their sum over all words and b the types) and z the word's root tables. a and b are totals over the
    shard: of x and of types with x > 0, or of y and of the root's tables.
    """
    out, rows = [], sorted(table.to_pylist(), key=lambda r: (r["kind"], r["chunk"]))
    shard = rows[0]["shard"]
    for kind in sorted({r["kind"] for r in rows}):
        own = [r for r in rows if r["kind"] == kind]
        keys = [unpack(r["keys"], np.uint64, True) for r in own]
        ends = np.cumsum([len(k) for k in keys])
        distinct, index = np.unique(np.concatenate(keys), return_inverse=True)
        x = np.concatenate([unpack(r["x"], np.uint64) for r in own]).astype(np.int64)
        sum_x = np.zeros(len(distinct), np.int64)
        np.add.at(sum_x, index, x)
        if kind >= SWEEP:
            sum_y = np.zeros(len(distinct), np.int64)
            np.add.at(sum_y, index, np.concatenate([unpack(r["y"], np.uint64) for r in own]).astype(np.int64))
            given = None
            if s.root_given:
                before = np.zeros(len(distinct), np.int64)
                before[index] = np.concatenate([unpack(r["z"], np.uint64) for r in own]).astype(np.int64)
                given = own[0]["a"] - before, own[0]["b"]
            root = root_tables(sum_y, distinct, kind - SWEEP, s, given)
            a, b, answer = sum_y.sum(), root.sum(), sum_x[index]
        else:
            sum_y, a, b, answer = None, sum_x.sum(), (sum_x > 0).sum(), sum_x[index]
        if kind == BIGRAM:
            first = np.full(len(distinct), len(x))
            has = np.flatnonzero(x > 0)
            np.minimum.at(first, index[has], has)
            answer = 2 * answer + (first[index] == np.arange(len(x)))
        for r, n, e in zip(own, map(len, keys), ends):
            of_word = (None, None) if sum_y is None else [pack(v[index[e - n:e]].astype(np.int64)) for v in (sum_y, root)]
            out.append((shard, kind, r["chunk"], pack(answer[e - n:e]), *of_word, int(a), int(b)))
    return _table(out, ANSWER_NAMES)


class Answers:
    """A chunk's answers and the corpus totals."""

    def __init__(self, table: pa.Table):
        self.rows: dict[int, list] = {}
        for r in table.to_pylist():
            self.rows.setdefault(r["kind"], []).append(r)

    def get(self, kind: int, column: str, n: int) -> np.ndarray:
        rows = sorted(self.rows.get(kind, []), key=lambda r: r["shard"])
        return np.concatenate([unpack(r[column], np.int64) for r in rows]) if rows else np.zeros(n, np.int64)

    def total(self, kind: int) -> tuple[int, int]:
        rows = self.rows.get(kind, [])
        return sum(r["a"] for r in rows), sum(r["b"] for r in rows)


@lru_cache(maxsize=4)
def stirling(discount: float, size: int) -> np.ndarray:
    """Generalised Stirling numbers S_d(c, t) for c, t up to ``size``."""
    out = np.zeros((size + 1, size + 1))
    out[1, 1] = 1.0
    for c in range(2, size + 1):
        t = np.arange(1, c + 1)
        out[c, 1:c + 1] = out[c - 1, 1:c + 1] * np.maximum(c - 1 - discount * t, 0.0) + out[c - 1, 0:c]
    return out


SMALL = 16      # products of so many probabilities stay in range
ROWS = 4096     # customers up to which log_ways are computed one by one


@lru_cache(maxsize=4)
def log_ways(discount: float, size: int) -> np.ndarray:
    """Logarithms of S_d(c, t) (t-1)! d^(t-1) / S_d(c, 1), between 0 and 1 and near 1 for large c:
    c up to ROWS, t from 1 to ``size``."""
    t = np.arange(1, size + 1)
    out = np.zeros((ROWS + 1, size))
    out[1, 0] = 1.0
    for c in range(1, ROWS):
        out[c + 1] = out[c] * np.maximum(c - discount * t, 0.0)
        out[c + 1, 1:] += discount * t[:-1] * out[c, :-1]
        out[c + 1] /= c - discount
    with np.errstate(divide="ignore"):
        return np.log(out)


@lru_cache(maxsize=4)
def ways_by_tables(discount: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``log_ways`` with a row per number of tables, so that sums run over whole rows, and their exponentials."""
    logs = np.ascontiguousarray(log_ways(discount, size).T)
    return logs, np.exp(logs)


def _window(c: np.ndarray, others: np.ndarray, base: np.ndarray, u: np.ndarray, strength: float, discount: float,
            size: int, few: bool = False) -> np.ndarray:
    """Draws from the weights of 1 to ``size`` tables. Beyond ROWS customers, what a
    logarithm of ``log_ways`` lacks to 0 falls with the customers' power -discount.
    With ``few`` tables to be expected and ROWS customers at most, weights are multiplied without logarithms."""
    t = np.arange(1, size)[:, None]
    opens = (strength + discount * (others + t)) * base / (discount * t)
    logs, plain = ways_by_tables(discount, size)
    if few:
        chance = plain[:, c]
        chance[1:] *= np.cumprod(opens, 0)
    else:
        ways = logs[:, np.minimum(c, ROWS)] * np.maximum(c / ROWS, 1.0) ** -discount
        ways[1:] += np.cumsum(np.log(opens), 0)
        chance = np.exp(ways - ways.max(0))
    chance = np.cumsum(chance, 0)
    return 1 + (chance < u * chance[-1]).sum(0)


_Z = np.linspace(-8.5, 8.5, 6801)
_BELOW = np.array([math.erfc(-z / math.sqrt(2)) / 2 for z in _Z])


def _large(c: np.ndarray, others: np.ndarray, base: np.ndarray, u: np.ndarray, strength: float, discount: float) -> np.ndarray:
    """Draws for dishes of many tables: a normal distribution around the weights' maximum.

    S_d(c, t) = c!/t! [x^c] f(x)^t with f(x) = (1 - (1-x)^d) / d. At the saddle point x = 1 - y its
    logarithm grows by log f(x) - log t with t, and by k/t for what the saddle point leaves out,
    k between 1 and 1/(2-2d); t is a function of y, so the maximum is found by bisection in log y.
    """
    def slope(z):
        power = np.exp(discount * z)
        f = -np.expm1(discount * z) / discount
        t = np.maximum(c * f * np.exp(z) / power / -np.expm1(z), 1e-9)
        tau = t / c ** discount
        k = (1 + tau / (2 - 2 * discount)) / (1 + tau)
        return np.log(f) - np.log(t) + k / t + np.log((strength + discount * (others + t)) * base), t
    lo, hi = np.log(discount / c) / (1 - discount), np.full(len(c), -1e-9)
    for _ in range(48):
        middle = (lo + hi) / 2
        up = slope(middle)[0] > 0
        lo, hi = np.where(up, middle, lo), np.where(up, hi, middle)
    at = (lo + hi) / 2
    (f1, t1), (f2, t2), mode = slope(at * 1.001), slope(at * 0.999), slope(at)[1]
    deviation = np.sqrt(np.maximum((t2 - t1) / np.maximum(f1 - f2, 1e-300), 0.0))
    return np.clip(np.rint(mode + np.minimum(deviation, c) * np.interp(u, _BELOW, _Z)), 1, c)


def draw_tables(customers: np.ndarray, others: np.ndarray, base: np.ndarray, u: np.ndarray, strength: float,
                discount: float, exact: int) -> np.ndarray:
    """A draw of each dish's tables from its conditional.

    ``others``: tables of the restaurant's other dishes; ``base``: the parent's
    probability of the dish; ``u``: one uniform per dish.
    """
    tables = np.minimum(customers, 1)
    small = np.minimum(customers, SMALL + 1)
    ways = stirling(discount, SMALL)
    order = np.argsort(small, kind="stable")
    ends = np.searchsorted(small[order], np.arange(2, SMALL + 2))
    for c in range(2, SMALL + 1):
        for i in range(ends[c - 2], ends[c - 1], (1 << 18) // c):
            at = order[i:min(i + (1 << 18) // c, ends[c - 1])]
            others_at, base_at = others[at], base[at]
            opens, total, chance = 1.0, 0.0, []
            for t in range(c):  # whole columns: rows of a few numbers are slow
                opens = opens * ((strength + discount * (others_at + t)) * base_at)
                total = total + opens * ways[c, t + 1]
                chance.append(total)
            least = u[at] * total
            tables[at] = 1 + sum((x < least).astype(tables.dtype) for x in chance)
    rows = order[ends[-1]:]
    if not len(rows):
        return tables
    # without the factor of log_ways, tables after the first would be negative binomial
    exact = max(exact, 64)
    left = np.maximum(1 - base[rows], 1e-9)
    mean = (strength / discount + others[rows] + 1) * base[rows] / left
    reach = mean + 7 * np.sqrt(mean / left + 1)
    near = (customers[rows] <= exact) | (reach < exact)
    few = (customers[rows] <= ROWS) & (reach < 64)  # products of 64 such chances stay in range
    far = rows[~near]
    for part, plain in ((rows[near & few], True), (rows[near & ~few], False)):
        for i in range(0, len(part), (1 << 18) // exact):
            at = part[i:i + (1 << 18) // exact]
            tables[at] = _window(customers[at], others[at], base[at], u[at], strength, discount, exact, plain)
    if len(far):
        tables[far] = _large(customers[far].astype(float), others[far], base[far], u[far], strength, discount)
    return tables


def uniform(keys: np.ndarray, sweep: int) -> np.ndarray:
    salt = np.uint64((2 * sweep + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return (mix(keys + salt) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def root_tables(customers: np.ndarray, words: np.ndarray, sweep: int, s: Settings,
                given: tuple[np.ndarray, int] | None = None) -> np.ndarray:
    """The root's tables of each word, given (the root's tables of the other words, types).

    Without them, as if every type had a single table: with at least one per type over a uniform
    base, a new one opens with a weight of the root's discount at least.
    """
    many = 1e9
    others, base = (np.full(len(customers), many), 1 / many) if given is None else (np.maximum(given[0], 0.0), 1 / (given[1] + 1))
    return draw_tables(customers, others, np.full(len(customers), base),
                       uniform(words, 1000 + sweep), s.root_strength, s.root_discount, s.exact)


class Model:
    """The state of the sampler as a chunk sees it: its bigrams' tables and the corpus sums it needs.

    With ``own_only`` only the tables of bigrams that this chunk counts are drawn.
    """

    def __init__(self, chunk: Chunk, answers: Answers, s: Settings, own_only: bool):
        self.chunk, self.answers, self.s = chunk, answers, s
        self.word = answers.get(WORD, "x", len(chunk.words))
        told = answers.get(BIGRAM, "x", len(chunk.bigrams))
        self.customers, self.counts_here = told >> 1, (told & 1) == 1
        self.tables = np.minimum(self.customers, 1)
        drawn = self.customers > 1  # a single customer has a single table
        self.drawn = np.flatnonzero(drawn & self.counts_here if own_only else drawn)
        # before the first sweep: tables as a power of the customers, and the words' own frequencies
        n, types = answers.total(WORD)
        self.types = types - (self.word[chunk.start] > 0)
        self.own, self.own_total = np.minimum(self.word, 1), int(self.types)  # the root's: one a type
        self.known: dict[int, tuple] = {0: (self.word ** s.discount, None, (self.word + 1.0) / (n + types + 1.0))}

    def sums(self, sweep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tables by context, tables by word, and the root's probability of each word, after a sweep."""
        if sweep not in self.known:
            self.known = {sweep: self._sums(sweep)}
        return self.known[sweep]

    def _sums(self, sweep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s, n = self.s, len(self.chunk.words)
        by_context = self.answers.get(SWEEP + sweep, "x", n)
        by_word = self.answers.get(SWEEP + sweep, "y", n)
        customers, tables = self.answers.total(SWEEP + sweep)
        self.own, self.own_total = self.answers.get(SWEEP + sweep, "z", n), tables
        root = by_word - s.root_discount * self.own + (s.root_strength + s.root_discount * tables) / (self.types + 1)
        return by_context, by_word, root / (s.root_strength + customers)

    def advance(self, sweep: int) -> None:
        """Draw the tables of sweep ``sweep`` from the sums after the one before."""
        by_context, _, root = self.sums(sweep - 1)
        left, right = self.chunk.left, self.chunk.right
        shared = self.drawn
        left, right = left[shared], right[shared]
        others = np.maximum(by_context[left] - self.tables[shared], 0.0)
        self.tables[shared] = draw_tables(self.customers[shared], others, root[right],
                                          uniform(self.chunk.bigrams[shared], sweep),
                                          self.s.strength, self.s.discount, self.s.exact)

    def probabilities(self, sweep: int) -> np.ndarray:
        """Of each bigram's word in its context."""
        s, left = self.s, self.chunk.left
        by_context, _, root = self.sums(sweep)
        new = s.strength + s.discount * by_context[left]
        return ((self.customers - s.discount * self.tables + new * root[self.chunk.right])
                / (s.strength + self.word[left]))


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 7, rest: int = 2,
          s: Settings = Settings(root_given=True, add_one=True)) -> DataFrame:
    """One row per document (SCHEMA); training texts are those whose crc32(id) mod ``mod`` is not ``rest``."""
    prepare(df.sparkSession)
    documents = id_text(df, id_col, text_col)
    chunks = chunk_count(documents, s.chunk_bytes)
    shards = max(12, chunks // 2)
    # a stated number of partitions, the same for chunks and answers: both lie in place for every sweep
    dealt = lambda rows: rows.repartition(chunks, "chunk")
    by_chunk = dealt(parsed(documents, s.chunk_bytes)).groupBy("chunk")

    def ask_counts(table: pa.Table) -> pa.Table:
        number, chunk = table["chunk"][0].as_py(), Chunk(table, mod, rest, s.bigram_bits)
        of_word, of_bigram = chunk.counts()
        return pa.concat_tables([_ask(WORD, number, shards, chunk.words, of_word),
                                 _ask(BIGRAM, number, shards, chunk.bigrams, of_bigram)])

    def state(table: pa.Table, answers: pa.Table, sweep: int, own_only: bool) -> tuple[Chunk, Model]:
        chunk = Chunk(table, mod, rest, s.bigram_bits)
        model = Model(chunk, Answers(answers), s, own_only)
        for k in range(1, sweep + 1):
            model.advance(k)
        return chunk, model

    def ask_sweep(sweep: int):
        def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
            if not table.num_rows:
                return _table([], QUESTION_NAMES)
            number = table["chunk"][0].as_py()
            chunk, model = state(table, answers, sweep, True)
            mine, n = np.flatnonzero(model.counts_here), len(chunk.words)
            sums = [np.bincount(side[mine], weights=model.tables[mine], minlength=n).astype(np.int64)
                    for side in (chunk.left, chunk.right)]
            before = (model.own, int(model.own_total), int(model.types)) if s.root_given else ()
            return _ask(SWEEP + sweep, number, shards, chunk.words, *sums, *before)
        return ask

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], k) for k in OUT.types], schema=OUT)
        chunk, model = state(table, answers, 0, False)
        total = np.zeros(len(chunk.bigrams))
        for sweep in range(1, s.sweeps + 1):
            model.advance(sweep)
            if sweep > s.burn_in:
                total += model.probabilities(sweep)
        n, types = model.answers.total(WORD)
        starts = int(model.word[chunk.start])  # the start of texts is a context, not a token
        n, types = n - starts, types - (starts > 0)
        by_word = np.log10((model.word + 1.0) / (n + types + 1.0 if s.add_one else (n + 1.0) * (types + 1.0)))
        log_p = np.log10(total / (s.sweeps - s.burn_in))
        add = lambda v: np.add.reduceat(v, chunk.starts)
        return pa.table([pa.array(chunk.ids, pa.int64()), pa.array(chunk.held_out), pa.array(chunk.sizes),
                         pa.array(add((model.word[chunk.target] > 0).astype(np.int64))),
                         pa.array(np.full(len(chunk.ids), n, np.int64)),
                         pa.array(add(by_word[chunk.target])), pa.array(add(log_p[chunk.bigram]))], schema=OUT)

    def answered(questions: DataFrame) -> DataFrame:
        return dealt(questions.groupBy("shard").applyInArrow(lambda table: _reply(table, s), ANSWER))

    known = answered(by_chunk.applyInArrow(ask_counts, QUESTION))
    for sweep in range(1, s.sweeps + 1):
        known = known.unionByName(answered(
            by_chunk.cogroup(known.groupBy("chunk")).applyInArrow(ask_sweep(sweep), QUESTION)))
    return by_chunk.cogroup(known.groupBy("chunk")).applyInArrow(finish, SCHEMA)


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                 ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
