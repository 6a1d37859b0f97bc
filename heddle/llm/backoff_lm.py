"""A weighted backoff automaton over word n-grams, trained and applied over all documents.

The automaton: a state for each history of up to three words that the training
texts have at least twice, besides the root. A state has an arc for each word
seen after its history; the arc leads to the longest state that the read words
end in. Where a state has no arc for the next word, its failure arc is taken,
to the state without the history's first word, until an arc fits; the root has
an arc for every word, unknown ones included. A text is read from left to right
in one pass that carries the state and adds the log10 weights of all arcs taken.

Smoothing: a state of history h passes the weight e on to its failure arc, and
an arc has p(w | h) = (1 - e) c(hw) / c(h) + e p(w | shorter h). e is the
leave-one-out chance of a word not seen after h: the share, among the training
tokens after histories of that length and that class of counts, of those whose
n-gram the training texts have once only. Histories seen once say nothing when
left out, so they are no states. The root's arcs are discounted against a uniform
share for the V + 1 symbols (training words, the end among them, and the unknown
word). Every state's arcs and what its failure arc leads to sum to one.

The whole automaton is never in one place. Documents are cut into blocks; a
block asks buckets of the hash range for the totals of the n-grams that occur in
it, sending its own counts with the question, and builds the part of the
automaton that its texts can reach. It asks level by level: n-grams of three
words only behind a history of two that is a state, and so on. Messages are
packed arrays with one entry for a distinct n-gram of a block, so a frequent
one never gathers anywhere. Words and n-grams are known by hashes of 64 bits, and all
totals are 64-bit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Coded, answered, bucket_starts, coded_blocks, counts_of, cut_prints, distinct_any, each_row, parts_of, prints_of, small_counts, whole_keys, with_answers
from .kernels import U64, mix64

#: Words of the longest n-gram, and occurrences that a history needs to be a state.
ORDER, LEAST = 4, 2
#: Words of a text that are read in one go; the next part starts from the state that the words before it lead to.
PART = 512
_MESSAGE = "bucket long, __block long, prints binary, small binary, big binary"
_ANSWER = "__block long, bucket long, small binary, big binary, stats array<long>"
_TALLY = "kind int, cell int, amount long"
_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_END, _START = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
#: Classes of histories by their count: each small count, then by powers of two.
_CLASSES, _SINGLE = 80, 16


def _class(total: np.ndarray) -> np.ndarray:
    power = np.frexp(np.maximum(total, 1).astype(float))[1]
    return np.where(total < _SINGLE, total, np.minimum(power + _SINGLE - 5, _CLASSES - 1)).astype(np.int64)


class _Block:
    """A block's texts as one stream, a start before and an end behind each, and its distinct n-grams.

    At every place of the stream, number[k] names the n-gram of k words that ends there, or -1 where it isn't asked for.
    """

    def __init__(self, row: pa.Table, n: int) -> None:
        self.n, self.coded = n, Coded(row)
        c = self.coded
        words = len(c.vocab)
        self.size = c.size + 2
        self.begin = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        total = int(self.begin[-1])
        self.code = np.full(total, words + 1, np.int64)
        self.code[self.begin[:-1]] = words
        inner = np.ones(total, bool)
        inner[self.begin[:-1]] = inner[self.begin[1:] - 1] = False
        self.code[inner] = c.codes
        self.vocab = np.concatenate([c.vocab, [_START, _END]]).astype(U64)
        self.place = np.arange(total) - np.repeat(self.begin[:-1], self.size)
        self.train = np.asarray(c.rest["train"].combine_chunks())
        self.weight = np.repeat(self.train, self.size)
        self.keys: dict[int, np.ndarray] = {}
        self.first: dict[int, np.ndarray] = {}
        self.number: dict[int, np.ndarray] = {1: self.code}
        self.total: dict[int, np.ndarray] = {}
        whole = whole_keys(self.vocab)
        self.order = np.argsort(whole)
        self.keys[1] = whole[self.order]
        hashes = self.vocab[self.code]
        self.hashes = {1: hashes}

    def open(self, k: int) -> None:
        """Finds the distinct n-grams of k words whose history of k - 1 may be a state (for k = 2: all).

        One whose last k - 1 words the training texts don't have is in none of them either, so it isn't asked for.
        """
        while k not in self.hashes:
            m = len(self.hashes) + 1
            before = np.empty_like(self.hashes[m - 1])
            before[1:], before[:1] = self.hashes[m - 1][:-1], 0
            self.hashes[m] = mix64(before * U64(0x2545F4914F6CDD1D) + self.hashes[1])
        fits = self.place >= k - 1
        if k > 2:
            fits[1:] &= self.repeated(k - 1)[:-1]
            fits &= self.seen(k - 1, 1)
        at = np.flatnonzero(fits)
        self.keys[k], first, number = distinct_any(whole_keys(self.hashes[k][at]))
        self.first[k] = at[first]
        self.number[k] = np.full(len(self.code), -1, np.int64)
        self.number[k][at] = number

    def repeated(self, k: int) -> np.ndarray:
        """Where a history of k words ends that is a state."""
        return self.seen(k, LEAST)

    def seen(self, k: int, least: int) -> np.ndarray:
        """Where k words end that the training texts have so many times."""
        number = self.number[k]
        return (number >= 0) & np.append(self.total[k] >= least, False)[number]

    def ask(self, k: int) -> pa.Table:
        counts = np.bincount(self.number[k][self.number[k] >= 0], self.weight[self.number[k] >= 0], len(self.keys[k])).astype(np.int64)
        cuts = bucket_starts(self.keys[k], self.n)
        full = np.flatnonzero(np.diff(cuts))
        cuts = np.append(cuts[full], cuts[-1])
        counts = counts[self.order] if k == 1 else counts
        prints = cut_prints(self.keys[k], cuts)
        small, big = small_counts(counts, cuts)
        return pa.table([pa.array(full + (k - 1) * self.n, pa.int64()), pa.array(np.full(len(full), self.coded.number, np.int64)), prints, small, big], names=["bucket", "__block", "prints", "small", "big"])

    def replay(self, row: pa.Table, upto: int) -> None:
        """Totals over all training texts for n-grams of up to `upto` words, from the answers of their levels."""
        for k in range(1, upto + 1):
            if k > 1:
                self.open(k)
            if k != 2:
                level = max(k - 2, 0)
                told = counts_of(row[f"small{level}"], row[f"big{level}"])
            words = len(self.keys[1])
            self.total[k] = told[:words] if k == 1 else told[words:] if k == 2 else told
            if k == 1:
                self.total[1] = np.empty_like(told[:words])
                self.total[1][self.order] = told[:words]

    def histories(self, k: int) -> np.ndarray:
        """For each n-gram of k words the number of its history, the k - 1 words before its last."""
        return self.number[k - 1][self.first[k] - 1]


class Automaton:
    """States 1, 2, ... for histories and 0 for the root; arcs by (state, word), failure arcs and their log10 weights.

    model: N, V, n1, n2 of the training words, then the failure weight of each class for each order.
    """

    def __init__(self, block: _Block, model: np.ndarray) -> None:
        n, v, n1, n2 = model[:4]
        passed = model[4:].reshape(ORDER + 1, _CLASSES)
        known = block.total[1]
        if n:
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            p = np.maximum(known - d, 0) / n + d * v / n / (v + 1)
        else:
            p = np.ones(len(known))
        self.width = len(known)
        self.root = np.log10(p)
        end = self.width - 1  # nothing follows it, so no history ends in it
        again = (known >= LEAST) & (np.arange(self.width) != end)
        states = int(again.sum())
        self.root_to = to = state = np.where(again, np.cumsum(again), 0)
        self.fail = [np.zeros(1 + states, np.int64)]
        self.back = [np.zeros(1), np.log10(passed[2][_class(known[again])])]
        keys, weights, targets = [], [], []
        for k in range(2, ORDER + 1):
            last, total = block.first[k], block.total[k]
            history = block.histories(k)
            above = block.total[k - 1][history]
            live = (total > 0) & (above >= LEAST)
            shorter = block.number[k - 1][last]
            e = passed[k][_class(above)]
            p = (1 - e) * total / np.maximum(above, 1) + e * p[shorter]
            again = live & (total >= LEAST) & (block.code[last] != end) & (k < ORDER)
            own = np.where(again, states + np.cumsum(again), 0)
            to = np.where(again, own, to[shorter])
            keys.append(state[history[live]] * self.width + block.code[last[live]])
            weights.append(np.log10(p[live]))
            targets.append(to[live])
            if k < ORDER:
                self.fail.append(state[shorter[again]])
                self.back.append(np.log10(passed[k + 1][_class(total[again])]))
                states += int(again.sum())
                state = own
        key = np.concatenate(keys)
        order = np.argsort(key)  # no two are equal
        self.arcs, self.weight, self.to = key[order], np.concatenate(weights)[order], np.concatenate(targets)[order]
        self.fail, self.back = np.concatenate(self.fail), np.concatenate(self.back)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each state over its word: log10 weight of the arcs taken, and the new state."""
        gain, new = np.zeros(len(state)), np.empty_like(state)
        left, at = np.arange(len(state)), state
        while len(left):
            key = at * self.width + word[left]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1) if len(self.arcs) else None
            found = self.arcs[arc] == key if arc is not None else np.zeros(len(left), bool)
            if arc is not None:
                gain[left[found]] += self.weight[arc[found]]
                new[left[found]] = self.to[arc[found]]
            root = ~found & (at == 0)
            gain[left[root]] += self.root[word[left[root]]]
            new[left[root]] = self.root_to[word[left[root]]]
            missed = ~found & (at > 0)
            gain[left[missed]] += self.back[at[missed]]
            left, at = left[missed], self.fail[at[missed]]
        return gain, new

    def read(self, block: _Block) -> np.ndarray:
        """Each text's log10 probability, all texts read side by side.

        A text of many words is read in parts: the state behind a word depends on
        the ORDER - 1 words up to it alone, so reading these from the root leads to it.
        """
        tokens = block.size - 1
        parts = -(-tokens // PART)
        text = np.repeat(np.arange(len(tokens)), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        first = block.begin[text] + 1 + nth * PART
        ends = np.minimum(first + PART, block.begin[text + 1])
        warm = np.where(nth == 0, 1, ORDER - 1)
        order = np.argsort(-(ends - first + warm), kind="stable")
        text, begin, warm, steps = text[order], (first - warm)[order], warm[order], (ends - first + warm)[order]
        state, score = np.zeros(len(text), np.int64), np.zeros(len(text))
        for t in range(int(steps[0]) if len(steps) else 0):
            active = int(np.searchsorted(-steps, -t, "left"))
            gain, state[:active] = self.step(state[:active], block.code[begin[:active] + t])
            score[:active] += np.where(t >= warm[:active], gain, 0)
        return np.bincount(text, score, len(tokens))


def _asks(n: int, level: int):
    """Questions of a level: words and pairs first, then one word more each time."""

    def ask(row: pa.Table) -> pa.Table:
        block = _Block(row, n)
        if level:
            block.replay(row, level + 1)
        block.open(level + 2)
        return pa.concat_tables([block.ask(k) for k in ((1, 2) if level == 0 else (level + 2,))])

    return ask


def _answers(n: int):
    def answer(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        counts = counts_of(table["small"], table["big"])
        prints, cuts = prints_of(table["prints"], U64)
        u, _, number = distinct_any(prints)
        # bincount adds doubles: whole numbers below 2**53, the high halves apart
        each = np.bincount(number, counts & 0xFFFFFFFF, len(u)).astype(np.int64) + (np.bincount(number, counts >> 32, len(u)).astype(np.int64) << 32)
        stats: list = [None] * table.num_rows
        if bucket < n:
            words = each[u != whole_keys(_START)]
            stats[0] = [int(words.sum()), int((words > 0).sum()), int((words == 1).sum()), int((words == 2).sum())]
        small, big = small_counts(each[number], cuts)
        return pa.table([table["__block"], table["bucket"], small, big, pa.array(stats, pa.list_(pa.int64()))], names=["__block", "bucket", "small", "big", "stats"])

    return answer


def _tallies(n: int):
    """A block's part of the statistics. Kind 0: the buckets' sums over words; 1 and 2: training tokens by order and class, all and those seen once."""

    def tally(row: pa.Table) -> pa.Table:
        rows = [(0, i, x) for i, x in enumerate(row["stats0"][0].as_py() or ())]
        block = _Block(row, n)
        block.replay(row, ORDER)
        for k in range(2, ORDER + 1):
            at = np.flatnonzero(block.weight & (block.number[k] >= 0))
            above = block.total[k - 1][block.number[k - 1][at - 1]]
            at, above = at[above >= LEAST], above[above >= LEAST]
            cell = k * _CLASSES + _class(above)
            once = block.total[k][block.number[k][at]] == 1
            for kind, sums in ((1, np.bincount(cell)), (2, np.bincount(cell[once]))):
                rows += [(kind, int(c), int(sums[c])) for c in np.flatnonzero(sums)]
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], names=["kind", "cell", "amount"])

    return tally


def _model(table: pa.Table) -> np.ndarray:
    """From the summed tallies (a few hundred rows at most) the automaton's parameters."""
    kind, cell, amount = (np.asarray(table[c].combine_chunks()) for c in ("kind", "cell", "amount"))
    sums = np.zeros((3, (ORDER + 1) * _CLASSES))
    sums[kind, cell] = amount
    # half a token imagined on either side keeps the weight inside (0, 1)
    return np.concatenate([sums[0, :4], (sums[2] + 0.5) / (sums[1] + 1)])


def _scores(n: int, model: np.ndarray):
    def score(row: pa.Table) -> pa.Table:
        block = _Block(row, n)
        block.replay(row, ORDER)
        total = block.total[1][block.code]
        # sums over the tokens of a text, its start left out
        per = lambda x: np.add.reduceat(np.where(block.place > 0, x, 0), block.begin[:-1])
        known, base = per((total > 0).astype(np.int64)), per(np.log10((total + 1) / (model[0] + model[1] + 1)))
        score = Automaton(block, model).read(block)
        ids = block.coded.rest["doc_id"].cast(pa.int64())
        return pa.table([ids, pa.array(~block.train), pa.array(block.size - 1), pa.array(known), pa.array(np.full(len(known), int(model[0]))), pa.array(base), pa.array(score)], names=[c.split()[0] for c in _OUT.split(", ")])

    return score


def score_texts(docs: DataFrame, train: F.Column | None = None, block_bytes: int | None = None) -> DataFrame:
    """Every text's log10 probability under an automaton learnt from the rows where `train` holds (all by default).

    docs: doc_id (integer), text. Tokens: the text's words with A-Z lower-cased,
    then one end. Returned per row: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score (add-one unigrams), score.

    A null or empty text is the end alone. If no row trains there is one symbol,
    the unknown word, so every text has probability one and score 0; train_tokens
    is 0 then, and such scores say nothing. A null `train` trains. Repeated rows each count.
    Other columns are ignored.
    """
    flag = F.coalesce(train, F.lit(True)) if train is not None else F.lit(True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", flag.alias("train"))
    blocks, n = coded_blocks(rows, lower=True, block_bytes=block_bytes)
    answers: list[DataFrame] = []
    for level in range(ORDER - 1):
        answers.append(answered(blocks, answers, _asks(n, level), _MESSAGE, _answers(n), _ANSWER, parts_of(n)))
    told = with_answers(blocks, answers)
    tallies = told.mapInArrow(each_row(_tallies(n)), _TALLY).groupBy("kind", "cell").agg(F.sum("amount").alias("amount"))
    model = _model(tallies.toArrow())
    return told.mapInArrow(each_row(_scores(n, model)), _OUT)


def query(spark, sf_dir: str) -> DataFrame:
    """Op 2 over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2
    return score_texts(docs, train)
