"""Spelling variant grouping by finite-state composition.

Words of a corpus are counted, and each frequent word's near words, one inserted, deleted or replaced letter away, are those that
the composition of the vocabulary acceptor, a one-edit transducer and the acceptor again accepts beside it. A word's form is its
most frequent near word where that is at least `ratio` times as frequent, and its root the last of the forms that follow.

No task holds the whole vocabulary. An edit leaves all of a word alone but one piece, so the acceptor reads a word with what lies
around a piece first: each (length, left, right) leads to an initial state whose right language is the pieces, of at most LETTERS
letters, that occur between them. Initial states are dealt over the tasks, and pairs are enumerated per initial state. A word
goes to one initial state a piece, for its own length and for the next, so that it meets longer words too. A task takes
Arrow batches of whole initial states and

1. builds the trie of their pieces and minimises it: trie nodes with one right language become one state, and initial states with
   the same pieces become one too. States count the words below each edge, so a path gives the number of its word;
2. composes: from (s, s) both sides read one letter to (t, t), or replace it, or the second side reads one letter more; from then on
   both read the same. An extra letter counts at its first place only (no equal letter follows), so no pair is met twice;
3. puts the pairs of numbers to all words of the initial states that share a state.

Per word only the number of its near words and the best of them leave the task. Words of over LETTERS * PIECES letters have longer
pieces; where an initial state of such words has over GROUP words, they are cut again, until pieces have LETTERS letters. An
initial state with pieces of that length has a bound that the alphabet sets. Counting and following forms are plain SQL functions;
n doubles along a chain of forms, so a few joins reach every root.

Nulls: a null text has no words; a null id counts as empty text. Repeated rows count each time. Ties of n go to the word first in
code-point order. Words without near words have themselves as root. No rows for tables without frequent words.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, shuffle_partitions
from .common import table
from .text import mixed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]+"  # of a text in lower case
LETTERS, PIECES, GROUP = 3, 8, 1 << 16
ROWS = 1 << 14  # words that a task handles at once, or one initial state
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2


def damaged(doc_id: Column, word: Column, every: int = 97) -> Column:
    """The word, without one letter where `every` divides the crc32 of `<doc_id>:<word>`."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    at = (h % F.char_length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))).otherwise(word)


def vocabulary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
               every: int = 97) -> DataFrame:
    """word, n: the words of all texts with their numbers."""
    runs = F.regexp_extract_all(F.translate(F.col(f"`{text}`"), UPPER, LOWER), F.lit(RUN), F.lit(0))
    words = docs.select(F.col(f"`{doc_id}`").alias("i"), F.explode(runs).alias("w")).select(damaged(F.col("i"), F.col("w"), every).alias("word"))
    return (words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count))


# --- initial states ---


def cut(words: DataFrame) -> DataFrame:
    """word, n, m, first, last (the part of the form of m letters where an edit may lie) to one row per piece of that part:
    also left, piece, right and width, the letters of the piece in a word of m letters."""
    step = F.greatest(F.lit(LETTERS), F.ceil((F.col("last") - F.col("first")) / PIECES)).cast("int")
    rows = words.withColumn("at", F.explode(F.sequence(F.col("first"), F.col("last") - 1, step)))
    rows = rows.withColumn("till", F.least(F.col("at") + step, F.col("last")))
    stop = F.col("till") - (F.col("m") - F.char_length("word"))
    return rows.select("m", F.substr("word", F.lit(1), F.col("at")).alias("left"), F.substr("word", F.col("at") + 1, stop - F.col("at")).alias("piece"),
                       F.substr("word", stop + 1).alias("right"), "n", (F.col("till") - F.col("at")).alias("width"))


def dealt(words: DataFrame) -> list[DataFrame]:
    """All words at all their initial states, none of which has over GROUP words with long pieces."""
    size = F.char_length("word")
    open_ = words.withColumn("m", F.explode(F.array(size, size + 1))).withColumn("first", F.lit(0)).withColumn("last", F.col("m"))
    out, state = [], ["m", "left", "right"]
    longest = words.agg(F.max(size)).first()[0] or 0
    rows = cut(open_)
    while longest > LETTERS * PIECES:
        rows = materialise(rows, "initial-states")
        big = rows.where(F.col("width") > LETTERS).groupBy(state).count().where(F.col("count") > GROUP).drop("count")
        if big.isEmpty():
            break
        big = materialise(big, "large-states")
        out.append(rows.join(big, state, "left_anti"))
        again = rows.join(big, state).select(F.concat("left", "piece", "right").alias("word"), "n", "m", F.char_length("left").alias("first"),
                                             (F.char_length("left") + F.col("width")).alias("last"))
        rows, longest = cut(again), -(-longest // PIECES)
    return [*out, rows]


# --- the composition ---


class Acceptor:
    """The minimised acceptor of the words of several initial states. Words are runs of `letters` from start[i] to stop[i], sorted
    by state and then letters; `of` is the number of the state. `root` is the minimised state, `base` the first word of each."""

    def __init__(self, letters: np.ndarray, start: np.ndarray, stop: np.ndarray, of: np.ndarray):
        alive, node = np.arange(len(start)), of.astype(np.int64)
        depth, levels, made = 0, [], int(of.max(initial=-1)) + 1
        ends = [(node[stop == start], None)]
        self.base = np.searchsorted(of, np.arange(made))
        counts = [np.bincount(of, minlength=made)]
        nodes = made
        while True:
            more = stop[alive] - start[alive] > depth
            alive, parent = alive[more], node[more]
            if not len(alive):
                break
            letter = letters[start[alive] + depth]
            new = np.ones(len(alive), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (letter[1:] != letter[:-1])
            node = nodes + np.cumsum(new) - 1
            first = np.flatnonzero(new)
            levels.append((parent[first], letter[first].astype(np.int64), node[first]))
            counts.append(np.diff(np.append(first, len(alive))))
            nodes += len(first)
            depth += 1
            ends.append((node[stop[alive] - start[alive] == depth], None))
        final = np.zeros(nodes, bool)
        final[np.concatenate([e[0] for e in ends])] = True
        below = np.concatenate(counts)
        #: A number per right language; trie nodes that agree in it are merged.
        language = final.astype(np.uint64) * np.uint64(0x51ED270B9F652295)
        for parent, letter, child in reversed(levels):
            np.add.at(language, parent, mixed(mixed(language[child]) + letter.astype(np.uint64)))
        self._merge(final, below, levels, language, made)

    def _merge(self, final, below, levels, language, made):
        _, first, state = np.unique(language, return_index=True, return_inverse=True)
        parent, letter, child = (np.concatenate([np.zeros(0, np.int64), *[x[k] for x in levels]]) for k in range(3))
        order = np.lexsort((letter, parent))
        parent, letter, child = parent[order], letter[order], child[order]
        # Each node must have the letters and states of the node that stands for its state; else two languages met in one number.
        begin, fan = np.searchsorted(parent, np.arange(len(final))), np.bincount(parent, minlength=len(final))
        lead = first[state]
        place = np.arange(len(parent)) - begin[parent]
        same_fan = (fan == fan[lead]).all() and (final == final[lead]).all()
        twin = begin[lead[parent]] + place
        if not (same_fan and (letter == letter[twin]).all() and (state[child] == state[child[twin]]).all()):
            state, first = np.arange(len(final)), np.arange(len(final))  # unmerged, which is as right
        self.root, self.final = state[:made], final[first]
        chosen = np.flatnonzero(first[state[parent]] == parent)
        chosen = chosen[np.lexsort((letter[chosen], state[parent[chosen]]))]
        self.source, self.letter, self.target = state[parent[chosen]], letter[chosen], state[child[chosen]]
        self.begin = np.searchsorted(self.source, np.arange(len(first) + 1))
        words = below[child[chosen]]
        total = np.concatenate([[0], np.cumsum(words)])
        #: Words of the source state that come before those of this edge; the word that ends there comes first.
        self.skip = total[:-1] - total[self.begin[self.source]] + self.final[self.source]

    def out(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of some states, all its edges: the place in `states`, and the edge."""
        fan = self.begin[states + 1] - self.begin[states]
        row = np.repeat(np.arange(len(states)), fan)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(fan) - fan, fan) + self.begin[states][row]

    def common(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For pairs of states, the edges with one letter: the place in p, the edge from p and that from q."""
        row, e = self.out(p)
        if not len(row):
            return row, e, e
        key = self.source * 256 + self.letter  # ascends
        want = q[row] * 256 + self.letter[e]
        f = np.minimum(np.searchsorted(key, want), len(key) - 1)
        hit = key[f] == want
        return row[hit], e[hit], f[hit]


def composed(a: Acceptor) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Accepted pairs of the initial states: the state, the numbers of both words in it, and the last letter of the second where the
    only edit is that it ends with one letter more, else 0."""
    roots = np.unique(a.root)
    root = state = roots
    x = np.zeros(len(roots), np.int64)
    got, tail = [], []
    while len(state):  # both sides have read the same letters and are in one state
        row, e = a.out(state)
        # An extra letter of the second side. None of the first side's next letters may equal it, so it counts at its first place.
        pairs = [(root[row], x[row], x[row] + a.skip[e], state[row], a.target[e], a.letter[e])]
        # One letter for another: each pair of edges once, the lesser letter first.
        fan = a.begin[state + 1][row] - 1 - e
        one = np.repeat(np.arange(len(e)), fan)
        two = e[one] + 1 + np.arange(len(one)) - np.repeat(np.cumsum(fan) - fan, fan)
        pairs.append((root[row[one]], x[row[one]] + a.skip[e[one]], x[row[one]] + a.skip[two], a.target[e[one]], a.target[two], np.zeros(len(one), np.int64)))
        r, left, right, p, q, banned = (np.concatenate(c) for c in zip(*pairs))
        first = True
        while len(r):  # after the edit both read the same
            both = a.final[p] & a.final[q]
            got.append((r[both], left[both], right[both], banned[both] if first else np.zeros(both.sum(), np.int64)))
            at, f, g = a.common(p, q)
            if first:
                ok = a.letter[f] != banned[at]
                at, f, g = at[ok], f[ok], g[ok]
            r, left, right, p, q = r[at], left[at] + a.skip[f], right[at] + a.skip[g], a.target[f], a.target[g]
            banned, first = banned[at], False
        root, x, state = root[row], x[row] + a.skip[e], a.target[e]
    return tuple(np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*got)) if got else (np.zeros(0, np.int64),) * 4


NEAR = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def enumerated(rows: pa.Table) -> pa.RecordBatch:
    """Of whole initial states, sorted by state and piece: per word the number of its near words there, and the best."""
    same = np.ones(max(rows.num_rows - 1, 0), bool)
    for c in ("m", "left", "right"):
        v = rows[c].combine_chunks()
        same &= np.asarray(pc.equal(v.slice(1), v.slice(0, max(len(v) - 1, 0))))
    of = np.concatenate([[0], np.cumsum(~same)]) if rows.num_rows else np.zeros(0, np.int64)
    size = np.bincount(of)
    alone = size[of] == 1
    if alone.any():
        rows, of = rows.filter(pa.array(~alone)), of[~alone]
        of = np.cumsum(np.diff(of, prepend=of[:1] - 1) > 0) - 1 if len(of) else of
    if not rows.num_rows:
        return pa.RecordBatch.from_pylist([], NEAR)
    left, piece, right = (rows[c].to_pylist() for c in ("left", "piece", "right"))
    data = [t.encode("latin-1") for t in piece]
    stop = np.cumsum([len(d) for d in data])
    start = stop - np.array([len(d) for d in data])
    a = Acceptor(np.frombuffer(b"".join(data), np.uint8), start, stop, of)
    root, one, two, last = composed(a)
    # Initial states that share a minimised state have the same pairs.
    order = np.argsort(a.root, kind="stable")
    first, number = np.searchsorted(a.root[order], root), np.bincount(a.root, minlength=int(a.root.max(initial=0)) + 1)[root]
    pair = np.repeat(np.arange(len(root)), number)
    group = order[np.repeat(first, number) + np.arange(len(pair)) - np.repeat(np.cumsum(number) - number, number)]
    x, y, last = a.base[group] + one[pair], a.base[group] + two[pair], last[pair]
    # A last letter that the text behind the piece repeats: the pair belongs to the piece where those letters end.
    after = np.array([ord(t[0]) if t else 0 for t in right], np.int64)
    ok = (last == 0) | (after[x] != last)
    # Two words that are both shorter than m letters meet among the words of their own length too.
    full = np.fromiter((len(p) + len(q) + len(r) for p, q, r in zip(left, piece, right)), np.int64, len(piece)) == rows["m"].to_numpy()
    ok &= full[x] | full[y]
    x, y = np.concatenate([x[ok], y[ok]]), np.concatenate([y[ok], x[ok]])
    met, x = np.unique(x, return_inverse=True)
    met_y, y = np.unique(y, return_inverse=True)  # the same words
    words = [left[i] + piece[i] + right[i] for i in met.tolist()]
    n = rows["n"].to_numpy()[met]
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[y], -n[y], x))
    begin = np.flatnonzero(np.diff(x[order], prepend=-1))
    best = y[order][begin]
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(np.bincount(x, minlength=len(words))), pa.array(n[best]),
                                       pa.array([words[k] for k in best.tolist()], pa.string())], schema=NEAR)


def _enumerate(batches):
    """Whole initial states at a time; what the last one of a batch still misses waits for the next."""
    held: list[pa.RecordBatch] = []
    waiting = 0
    state = lambda b, i: tuple(b.column(b.schema.get_field_index(c))[i].as_py() for c in ("m", "left", "right"))
    for b in batches:
        if not b.num_rows:
            continue
        last = state(b, b.num_rows - 1)
        low, high = 0, b.num_rows - 1  # the first row of the last state
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if state(b, mid) == last else (mid + 1, high)
        ends = low > 0 or (held and state(held[-1], held[-1].num_rows - 1) != last)
        if ends and waiting + low >= ROWS:
            yield enumerated(pa.Table.from_batches([*held, b.slice(0, low)]))
            held, waiting = [], 0
            b = b.slice(low)
        held.append(b)
        waiting += b.num_rows
    if held:
        yield enumerated(pa.Table.from_batches(held))


def near(words: DataFrame) -> DataFrame:
    """word, n_near, form, form_n: for words (word, n) that have near words, their number and the best of them."""
    partitions = shuffle_partitions(words.sparkSession)
    state = ["m", "left", "right"]
    parts = [rows.select(*state, "piece", "n").repartition(partitions, *state).sortWithinPartitions(*state, "piece")
             .mapInArrow(_enumerate, "word string, near long, best_n long, best string") for rows in dealt(words)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return (found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", F.col("b.word").alias("form"), (-F.col("b.less")).alias("form_n")))


def grouped(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of each of the distinct words (word, n)."""
    words = materialise(words.select("word", "n"), "vocabulary")
    strong = F.col("form_n") >= F.col("n") * ratio
    out = words.join(near(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("form")).alias("form"), F.when(strong, F.col("form_n")).alias("form_n"))
    out = materialise(out, "forms")
    follow = out.where("form is not null").select("word", F.col("form").alias("root"))
    most = out.agg(F.max("n")).first()[0] or 1
    chain = max(1, math.floor(math.log(max(most, 2), ratio)))  # forms that can follow one another
    for _ in range(math.ceil(math.log2(chain)) + 1 if chain > 1 else 0):
        step = follow.select(F.col("word").alias("root"), F.col("root").alias("next"))
        follow = materialise(follow.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return out.join(follow, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(vocabulary(table(spark, sf_dir, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {"op11_spelling_variants": (op11_spelling_variants, None)}
