"""Subword lattice likelihood: the marginal probability of a text over all its segmentations."""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.common import stored, text_or_empty

FLUSH = 150_000  # distinct words a task counts before it passes them on
HOT = 1 << 17  # at most so many frequent words whose scores every task holds; all others meet theirs in a shuffle
PRIOR = 100.0  # the vocabulary's own scores: a piece of rank r starts with a weight of 1 / (r + PRIOR)
ROUNDS = 4  # EM steps, each over all training words
SMOOTH = 0.1  # added to the expected count of each piece and of the end
DISCOUNT = 0.75  # taken from each training word's count for the lattice's share of the mixture
LONG = 128  # words above so many bytes are scored alone, in the same way
GROUP = 1 << 19  # bytes of words scored together, about
WORDS = 1 << 16  # words of a task that are scored together, at most
LOG10 = np.log(10.0)


def held_out(doc_id: int | None) -> bool:
    """Whether crc32 of the id as text leaves 2 by 7; a null id never does."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def read_pieces(path: str) -> list[bytes]:
    """The byte strings of a vocabulary file of ranks, best rank first."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    return [base64.b64decode(a) for a, _ in sorted(rows, key=lambda r: int(r[1]))]


class Trie:
    """The pieces' bytes as a double array: the child of node ``n`` by byte ``c`` is ``base[n] + c`` if ``owner`` there is ``n``.

    ``piece`` has the number of the piece that ends at a node, -1 for none. No
    piece that goes on after a blank is held: a blank begins each word.
    """

    def __init__(self, pieces: list[bytes]):
        below: list[dict[int, int]] = [{}]
        ends = {}
        for i, p in enumerate(pieces):
            if not p or b" " in p[1:]:
                continue
            at = 0
            for c in p:
                if (to := below[at].get(c)) is None:
                    to = below[at][c] = len(below)
                    below.append({})
                at = to
            ends[at] = i
        self.depth = max((len(pieces[i]) for i in ends.values()), default=0)
        self._place(below, ends)

    def _place(self, below: list[dict[int, int]], ends: dict[int, int]) -> None:
        """Nodes with most children first, each at the next place where all of its children find free slots; those of one child fill the gaps."""
        size = 4 * len(below) + 2048
        used, base, slot = np.zeros(size, bool), np.zeros(len(below), np.int64), np.zeros(len(below), np.int64)
        used[:256], at, children = True, 256, 256
        for node in sorted((n for n in range(len(below)) if len(below[n]) > 1), key=lambda n: (-len(below[n]), n)):
            if len(below[node]) < children:
                at, children = 256, len(below[node])  # fewer children may fit where more did not
            letters = np.array(sorted(below[node]))
            while not (fits := ~used[at + np.arange(256)[:, None] + letters].any(axis=1)).any():
                at += 256
            at += int(np.argmax(fits))
            used[at + letters], base[node] = True, at
        alone = np.array([n for n in range(len(below)) if len(below[n]) == 1], dtype=np.int64)
        base[alone] = np.flatnonzero(~used)[: len(alone)] - [next(iter(below[n])) for n in alone.tolist()]
        owner = np.zeros(len(below), np.int64)
        for node, letters in enumerate(below):
            for c, child in letters.items():
                slot[child], owner[child] = base[node] + c, node
        top = int(max(slot.max(), base.max())) + 257
        self.base, self.owner, self.piece = np.zeros(top, np.int32), np.full(top, -1, np.int32), np.full(top, -1, np.int32)
        self.base[slot] = base
        self.owner[slot[1:]] = slot[owner[1:]]
        for node, i in ends.items():
            self.piece[slot[node]] = i


class Lattice:
    """Unigram log-probabilities of byte pieces, with marginals over all segmentations.

    A blank begins each word, so pieces with a leading blank are word starts; no
    piece reaches over a blank, and a text's marginal is the product of its
    words' and the end's. Many words go through the recursion together, longest
    first, so that those that reach a position are a prefix of them: the trie
    finds the pieces that start at a position, then the forward recursion in log
    space adds up each position's segmentations. Words above LONG bytes go
    through the same recursion alone, a block of positions at a time.
    """

    def __init__(self, pieces: list[bytes], logs: np.ndarray, end: float, trie: Trie | None = None):
        self.trie = Trie(pieces) if trie is None else trie
        self.logs, self.end, self.none, self.longest = np.asarray(logs), end, len(pieces), self.trie.depth

    def _together(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
        """(word numbers, bytes at each position, words that reach each position), a bounded number of bytes at a time."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        part = np.cumsum(lengths[order] + 1) // GROUP
        for group in np.split(order, np.flatnonzero(np.diff(part)) + 1) if len(order) else []:
            n = lengths[group] + 1
            reach = np.searchsorted(-n, -np.arange(n[0] + 1), side="right")  # words of that many bytes or more
            flat = np.frombuffer(b"".join(b" " + words[i] for i in group.tolist()), np.uint8)
            starts = np.cumsum(n) - n
            yield group, [flat[starts[: reach[t + 1]] + t] for t in range(n[0])], reach

    def _edges(self, letters: list[np.ndarray], reach: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """By start: (end, words, pieces) of the pieces found there."""
        base, owner, piece, out = self.trie.base, self.trie.owner, self.trie.piece, []
        for t in range(len(letters)):
            found, words, node = [], np.arange(len(letters[t])), np.zeros(len(letters[t]), np.int32)
            for e in range(t, min(t + self.longest, len(letters))):
                if words[-1] >= len(letters[e]):
                    k = int(np.searchsorted(words, len(letters[e])))
                    words, node = words[:k], node[:k]
                to = base[node] + letters[e][words]
                hit = np.flatnonzero(owner[to] == node)
                if not len(hit):
                    break
                words, node = words[hit], to[hit]
                ids = piece[node]
                whole = np.flatnonzero(ids >= 0)
                if len(whole):
                    found.append((e + 1, words, ids) if len(whole) == len(ids) else (e + 1, words[whole], ids[whole]))
            out.append(found)
        return out

    def _forward(self, edges: list, reach: np.ndarray) -> list[np.ndarray]:
        """The log-probability of each position by the words that reach it."""
        alpha = [np.zeros(reach[0])]
        into: list[list] = [[] for _ in range(len(edges) + 1)]
        for t, found in enumerate(edges):
            if t:
                alpha.append(_log_sum(into[t], reach[t])[0])
                into[t] = []
            for e, words, ids in found:
                into[e].append((words, alpha[t][words] + self.logs[ids]))
        alpha.append(_log_sum(into[-1], reach[len(edges)])[0])
        return alpha

    def _blocks(self, row: np.ndarray, begin: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """(starts, ends, pieces) of a long word's pieces that start in one block, by start, and the rows of each start."""
        starts = np.arange(begin, min(begin + block, len(row)))
        node, at, to, ids = np.zeros(len(starts), np.int32), [], [], []
        for n in range(1, self.longest + 1):
            k = int(np.searchsorted(starts, len(row) - n, side="right"))
            starts, node = starts[:k], node[:k]
            child = self.trie.base[node] + row[starts + n - 1]
            hit = np.flatnonzero(self.trie.owner[child] == node)
            if not len(hit):
                break
            starts, node = starts[hit], child[hit]
            found = self.trie.piece[node]
            whole = np.flatnonzero(found >= 0)
            at.append(starts[whole])
            to.append(starts[whole] + n)
            ids.append(found[whole])
        order = np.argsort(np.concatenate(at), kind="stable")
        place, ends, pieces = np.concatenate(at)[order], np.concatenate(to)[order], np.concatenate(ids)[order]
        return place, ends, pieces, np.split(np.arange(len(place)), np.flatnonzero(np.diff(place)) + 1)

    def _long_forward(self, row: np.ndarray, block: int) -> np.ndarray:
        alpha = np.full(len(row) + 1, -np.inf)
        alpha[0] = 0
        for begin in range(0, len(row), block):
            place, ends, pieces, parts = self._blocks(row, begin, block)
            logs = self.logs[pieces]
            for part in parts:
                alpha[ends[part]] = np.logaddexp(alpha[ends[part]], alpha[place[part[0]]] + logs[part])
        return alpha

    @staticmethod
    def _row(word: bytes) -> np.ndarray:
        return np.frombuffer(b" " + word, np.uint8)

    def _long(self, word: bytes, block: int = 4096) -> float:
        """The marginal of a word of any length."""
        return float(self._long_forward(self._row(word), block)[-1])

    def _long_uses(self, word: bytes, block: int = 4096) -> np.ndarray:
        """Expected uses of each piece in a word of any length: forward, then backward a block of starts at a time."""
        row, out = self._row(word), np.zeros(self.none)
        alpha, beta = self._long_forward(row, block), np.full(len(row) + 1, -np.inf)
        beta[-1] = 0
        for begin in reversed(range(0, len(row), block)):
            place, ends, pieces, parts = self._blocks(row, begin, block)
            logs = self.logs[pieces]
            for part in reversed(parts):
                beta[place[part[0]]] = np.logaddexp.reduce(logs[part] + beta[ends[part]])
            out += np.bincount(pieces, weights=np.exp(alpha[place] + logs + beta[ends] - alpha[-1]), minlength=self.none)
        return out

    def marginals(self, words: list[bytes]) -> np.ndarray:
        """The natural log-probability of each word."""
        out = np.zeros(len(words))
        short = np.array([i for i, w in enumerate(words) if len(w) <= LONG], dtype=np.int64)
        for group, letters, reach in self._together([words[i] for i in short.tolist()]):
            alpha = self._forward(self._edges(letters, reach), reach)
            for t in range(1, len(alpha)):  # words that end there
                to = reach[t + 1] if t + 1 < len(alpha) else 0
                out[short[group[to : reach[t]]]] = alpha[t][to:]
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._long(w)
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in ``counts`` of ``words``: forward and backward over whole words."""
        out = np.zeros(self.none)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        if len(short) < len(words):
            for w, c in zip(words, counts, strict=True):
                if len(w) > LONG:
                    out += c * self._long_uses(w)
        times = np.asarray(counts, dtype=float)[short]
        for group, letters, reach in self._together([words[i] for i in short]):
            edges = self._edges(letters, reach)
            alpha = self._forward(edges, reach)
            total = np.concatenate([alpha[t][(reach[t + 1] if t + 1 < len(alpha) else 0) :] for t in range(len(alpha) - 1, 0, -1)])
            beta: list[np.ndarray] = [np.zeros(0)] * len(edges) + [np.zeros(reach[len(edges)])]
            ids, uses, weight = [], [], times[group]
            for t in range(len(edges) - 1, -1, -1):
                rows = [(words, beta[e][words] + self.logs[found]) for e, words, found in edges[t]]
                low, parts, top = _log_sum(rows, len(letters[t]))
                beta[t] = np.concatenate((low, np.zeros(reach[t] - len(low))))  # words that end at t have nothing left
                share = weight[: len(low)] * np.exp(alpha[t][: len(low)] + top - total[: len(low)])
                for (_, words, found), part in zip(edges[t], parts, strict=True):
                    ids.append(found)
                    uses.append(part * share[words])
            out += np.bincount(np.concatenate(ids), weights=np.concatenate(uses), minlength=self.none)
        return out


def _log_sum(rows: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """log(sum(exp)) by word of ``rows`` (words, values), each word once a row; the exps, and the largest values they are taken from."""
    top = np.full(n, -np.inf)
    for words, values in rows:
        top[words] = np.maximum(top[words], values)
    total, parts = np.zeros(n), []
    for words, values in rows:
        part = np.exp(values - top[words])
        total[words] += part
        parts.append(part)
    with np.errstate(divide="ignore"):
        return top + np.log(total), parts, top


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, c, total) over all of ``docs`` (doc_id, body): its count in training texts, and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()

        def out() -> pa.RecordBatch:
            for w, n in outside.items():
                inside[w] += 0
            words = list(inside)
            c = np.fromiter(inside.values(), np.int64, len(words))
            total = c + np.fromiter((outside.get(w, 0) for w in words), np.int64, len(words))
            inside.clear()
            outside.clear()
            return pa.record_batch([pa.array(words, pa.binary()), pa.array(c), pa.array(total)], names=["word", "c", "total"])

        for b in batches:
            for doc_id, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                (outside if held_out(doc_id) else inside).update(body.as_py().lower().split())
                if len(inside) + len(outside) > FLUSH:
                    yield out()
        yield out()

    return docs.mapInArrow(run, "word binary, c long, total long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))


def frequent_words(words: DataFrame, count: str, limit: int) -> DataFrame:
    """The words in the highest classes of ``count`` that hold at most ``limit`` together.

    Classes are sixteenths of a doubling, so their sizes are a table of some
    hundred rows, and no task sends more than its own words of those classes.
    """
    level = F.floor(F.log2(count) * 16)
    sizes = words.where(F.col(count) > 0).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, held = None, 0
    for r in sorted(sizes, reverse=True):
        if (held := held + r.n) > limit:
            break
        least = r.level
    return words.where(F.lit(False) if least is None else (F.col(count) > 0) & (level >= least))


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches of a task, put together to at least ``rows`` rows but for the last."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def train(words: DataFrame, pieces: list[bytes], ends: int, rounds: int = ROUNDS) -> Lattice:
    """A lattice whose scores are EM steps from the vocabulary's own scores.

    Each step goes over all training words. Each task adds up expected uses for
    its words; per piece they are summed before they reach the driver, at most
    one row a piece. ``ends`` is the number of training texts. All
    probabilities, with the end's, sum to one.
    """
    start = 1 / (np.arange(len(pieces)) + PRIOR)
    lattice = Lattice(pieces, np.log(start / start.sum()), 0.0)
    known = words.where("c > 0").select("word", "c")
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], now: Lattice = lattice) -> Iterator[pa.RecordBatch]:
            total = np.zeros(now.none)
            for t in _gathered(batches, WORDS):
                total += now.expected(t.column(0).to_pylist(), t.column(1).to_numpy())
            used = np.flatnonzero(total)
            yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["piece", "uses"])

        found = known.mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        uses = np.full(len(pieces) + 1, SMOOTH)
        for r in found:
            uses[r.piece] += r.uses
        uses[-1] += ends
        logs = np.log(uses / uses.sum())
        lattice = Lattice(pieces, logs[:-1], float(logs[-1]), lattice.trie)
    return lattice


def initial_share(lattice: Lattice, pieces: list[bytes]) -> float:
    """The probability of the pieces that begin a word."""
    return float(np.exp(lattice.logs[[i for i, p in enumerate(pieces) if p.startswith(b" ")]]).sum())


def mixed_logs(spelled: np.ndarray, counts: np.ndarray, n: int, types: int, end: float, first: float) -> np.ndarray:
    """Natural log-probabilities of words as tokens of a mixture of whole words and their spellings.

    A training word has its discounted share of the ``n`` training tokens; what
    the discount takes from the ``types`` distinct tokens weights the lattice's
    probabilities ``spelled``, scaled to sum to one over words by the share
    ``first`` of pieces that begin a word. Without training tokens the lattice
    stands alone.
    """
    if not n:
        return spelled
    share = np.log(DISCOUNT * types / n) + np.log1p(np.exp(end) / first)
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(np.maximum(counts - DISCOUNT, 0) / n), spelled + share)


def score(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mixed_score) of every row.

    Tokens are the runs of other than ASCII white space, ASCII letters in lower
    case, and an end. Training texts are those whose id's crc32 does not leave 2
    by 7. All scores are log10 probabilities of the whole text: ``base_score`` by
    the add-one word model, ``score`` by the lattice, the marginal over all
    segmentations into vocabulary pieces, and ``mixed_score`` by a mixture of
    training words as wholes and the lattice's spelling. The lattice spells
    unknown words out, which the word model leaves open. Words are counted in a
    first pass over all texts; in a second each task scores the HOT most
    frequent words from values it holds, and passes on a text's other words,
    which meet theirs in a shuffle keyed by word. Null and empty texts are an
    end alone. A null id trains. Repeated rows count each time and keep their
    rows; an empty table gives an empty table; other columns are not read.
    """
    pieces = read_pieces(vocabulary)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).cast("binary").alias("body"))
    counts = stored(count_words(rows), "words")
    ids = docs.select(F.col(doc_id).cast("string").alias("id"))
    ends = ids.where(~(F.crc32(F.coalesce("id", F.lit("")).cast("binary")) % 7).eqNullSafe(2) | F.col("id").isNull()).count()
    sums = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = (sums.n or 0) + ends, (sums.v or 0) + (ends > 0)
    lattice = train(counts, pieces, ends)
    first_share = initial_share(lattice, pieces)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches, WORDS):
            spelled = lattice.marginals(t.column(0).to_pylist())
            mixed = mixed_logs(spelled, t.column(1).to_numpy(), n, v, lattice.end, first_share)
            yield from t.append_column("s", pa.array(spelled / LOG10)).append_column("x", pa.array(mixed / LOG10)).to_batches()

    known = stored(counts.mapInArrow(weigh, "word binary, c long, total long, s double, x double"), "scored")
    top = frequent_words(known, "total", HOT).select("word", "c", "s", "x").toPandas()
    hot = docs.sparkSession.sparkContext.broadcast({bytes(w): (int(c > 0), float(np.log10(c + 1)), s, x) for w, c, s, x in top.itertuples(index=False)})
    below = float(np.log10(n + v + 1)) if n else 0.0
    end = int(ends > 0), float(np.log10(ends + 1)), lattice.end / LOG10, float(np.log10((ends - DISCOUNT) / n)) if ends else lattice.end / LOG10
    fields = "row long, doc_id long, held_out boolean, n long, known long, base double, score double, mixed double, rare array<binary>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = hot.value, TaskContext.get().partitionId() << 33
        for b in batches:
            out = []
            for doc, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = Counter(body.as_py().lower().split())
                rare, times, (k, base, s, x), n = [], [], end, 1
                for w, m in words.items():
                    n += m
                    if (known := held.get(w)) is None:
                        rare.append(w)
                        times.append(m)
                    else:
                        k += m * known[0]
                        base += m * known[1]
                        s += m * known[2]
                        x += m * known[3]
                out.append((number, doc, held_out(doc), n, k, base, s, x, rare, times))
                number += 1
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())]
            names = [f.split()[0] for f in fields.split(", ")]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 10, types, strict=True)], names=names)

    first = stored(rows.mapInArrow(run, fields), "first")
    rare = first.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("m"))
    met = rare.join(known.select("word", "c", "s", "x"), "word")
    met = met.select("row", (F.col("m") * (F.col("c") > 0).cast("int")).alias("k"), (F.col("m") * F.log10(F.col("c") + 1)).alias("b"), (F.col("m") * F.col("s")).alias("t"), (F.col("m") * F.col("x")).alias("u"))
    more = met.groupBy("row").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("t").alias("t"), F.sum("u").alias("u"))
    zero = lambda name: F.coalesce(name, F.lit(0))
    return first.drop("rare", "times").join(more, "row", "left").select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        (F.col("known") + zero("k")).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b") - F.col("n") * below).alias("base_score"),
        (F.col("score") + zero("t")).alias("score"),
        (F.col("mixed") + zero("u")).alias("mixed_score"),
    )
