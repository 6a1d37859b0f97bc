"""Language identification by segmentation-marginalised unigrams.

A language gives every piece of a fixed public vocabulary a probability. A word
can be cut into pieces in many ways; its probability is the sum over all of
them, by the forward algorithm, and a text's is the product over its words. The
pieces' probabilities are fitted by expectation maximisation on a bounded
sample of the labelled rows (SAMPLE_BYTES of text for each language).

A word here is a run of a-z and bytes from 0x80 on, after lower-casing, with a
mark in front as in the vocabulary; single bytes are pieces too, so that every
word can be read. Words are read once per batch and counted, the lattice of all
words of a batch is worked position by position in numpy.

A run of any length is one word. The forward sums at a position depend on those
of the LONGEST positions before it only, and linearly; so a long word's
stretches are worked side by side, each as the matrix from the sums before it to
the sums at its end, and the matrices are then multiplied in order. No
segmentation is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import _BYTE, U64, chunks, mix64, release, text_bytes
from .kernels import _powers as powers
from .session import bounded

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Text of each language that the fit may take, and rounds of it.
SAMPLE_BYTES, ROUNDS = 1_500_000, 5
#: Bytes of a stretch of a long word; the fit (not the prediction) reads longer words in parts of this.
STRETCH = 256
#: Positions after which the forward sums are scaled anew.
_RESCALE = 16
_SPACE = 0x20


def vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The vocabulary's pieces that a word can hold, the word mark written as a blank, and all single bytes.

    Words are runs of lower-cased letters, so a piece with a capital, a digit, a sign or an inner mark stands in none.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        body = p.removeprefix("\u2581")
        if (body.isalpha() or not body) and body == body.lower() and "\u2581" not in body:
            pieces.add(p.replace("\u2581", " ").encode())
    return sorted(pieces)


class Pieces:
    """Lookup of byte strings by hash, with a bit map in front."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.n = len(pieces)
        self.lengths = sorted({len(p) for p in pieces})
        self.longest = self.lengths[-1]
        data = np.frombuffer(b"".join(pieces), np.uint8)
        offs = np.cumsum([0, *map(len, pieces)])
        h = self.spans(data, offs[:-1], offs[1:])
        self.order = np.argsort(h)
        self.hash = h[self.order]
        self.some = np.zeros(1 << 20, bool)
        self.some[h >> U64(44)] = True

    @staticmethod
    def prefix(data: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTE[data] * powers.upto(len(data) + 1)[1][: len(data)], out=total[1:])
        return total

    def spans(self, data: np.ndarray, a: np.ndarray, z: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
        total = self.prefix(data) if total is None else total
        return mix64((total[z] - total[a]) * powers.upto(len(data) + 1)[0][a] + (z - a).astype(U64))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and these pieces' numbers."""
        at = np.flatnonzero(self.some[h >> U64(44)])
        where = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        good = self.hash[where] == h[at]
        return at[good], self.order[where[good]]


def words_of(data: np.ndarray, offs: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct marked words as (bytes, offsets), and for each occurrence its word; with the occurrences' offsets by text, and the words' counts.

    most: longer words are read in parts (the fit only).
    """
    letter = (data >= 0x80) | ((data >= 97) & (data <= 122))
    begin = letter.copy()
    begin[1:] &= ~letter[:-1]
    inner = offs[(offs > 0) & (offs < len(data))]
    begin[inner] = letter[inner]
    stop = letter.copy()
    stop[:-1] &= ~letter[1:]
    stop[inner - 1] = letter[inner - 1]
    a, z = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    while most and len(a) and (z - a).max() > most:
        long = np.flatnonzero(z - a > most)
        cut = a[long] + most
        for _ in range(3):  # not inside a character
            cut -= (data[cut] & 0xC0) == 0x80
        a, z = np.insert(a, long + 1, cut), np.insert(z, long, cut)
    of = np.searchsorted(a, offs)
    total = Pieces.prefix(data)
    h = mix64((total[z] - total[a]) * powers.upto(len(data) + 1)[0][a] + (z - a).astype(U64))
    _, first, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    size = (z - a)[first] + 1
    out = np.full(int(size.sum()), _SPACE, np.uint8)
    bounds = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(len(out)) - np.repeat(bounds[:-1], size)
    source = np.repeat(a[first], size) + at - 1
    out[at > 0] = data[source[at > 0]]
    return out, bounds, inverse, of, count


class Lattice:
    """All ways to cut some lanes of bytes into pieces: for each end position and piece length, lanes and pieces.

    A lane is begin .. end of the data; its pieces may begin from `low` on, before the lane itself.
    """

    def __init__(self, pieces: Pieces, data: np.ndarray, which: np.ndarray, low: np.ndarray, begin: np.ndarray, end: np.ndarray, total: np.ndarray) -> None:
        order = np.argsort(begin - end, kind="stable")
        low, begin, end = low[order], begin[order], end[order]
        self.which, self.size, self.longest = which[order], end - begin, pieces.longest
        self.steps: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[]]
        self.active = [len(which)]
        for i in range(1, int(self.size[0]) + 1):
            active = int(np.searchsorted(-self.size, -i, "right"))
            stop = begin[:active] + i
            room = stop - low[:active]
            widest, narrowest = int(room.max()), int(room.min())
            step = []
            for n in pieces.lengths:
                if n > widest:
                    break
                if n <= narrowest:
                    lane, piece = pieces.find(pieces.spans(data, stop - n, stop, total))
                else:
                    own = np.flatnonzero(room >= n)
                    lane, piece = pieces.find(pieces.spans(data, stop[own] - n, stop[own], total))
                    lane = own[lane]
                if len(lane):
                    step.append((n, lane, piece))
            self.steps.append(step)
            self.active.append(active)

    def forward(self, p: np.ndarray, whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled sums at each lane's last `longest` positions (lane, position, from, language), their log scales, and the log sum at every position if there is one language.

        whole: the lanes are words, so their sums come from an empty beginning. Otherwise the sums are those from
        each of the `longest` positions up to the lane's beginning.
        """
        size, k, back = int(self.size[0]), p.shape[1], self.longest
        froms = 1 if whole else back
        n = len(self.which)
        sums = np.zeros((back + size, n, froms, k))
        if whole:
            sums[back - 1] = 1
        else:
            sums[np.arange(back), :, np.arange(back)] = 1
        log = np.zeros((n, froms, k))
        last, scale = np.empty((n, back, froms, k)), np.empty((n, froms, k))
        logs = np.full((size + 1, n), -np.inf) if whole and k == 1 else np.empty((0, 0))
        if logs.size:
            logs[0] = 0
        for i in range(1, size + 1):
            now, active = sums[back - 1 + i], self.active[i]
            for m, lane, piece in self.steps[i]:
                now[lane] += sums[back - 1 + i - m, lane] * p[piece][:, None, :]
            if logs.size:
                logs[i, :active] = np.log(np.maximum(now[:active, 0, 0], 1e-300)) + log[:active, 0, 0]
            done = slice(self.active[i + 1] if i < size else 0, active)
            if done.start < done.stop:
                last[done], scale[done] = sums[i : back + i, done].transpose(1, 0, 2, 3), log[done]
            if i % _RESCALE == 0:
                tail = sums[i : back + i, :active]
                most = tail.max(0)
                most[most == 0] = 1
                tail /= most
                log[:active] += np.log(most)
        return last, scale, logs

    def expected(self, p: np.ndarray, count: np.ndarray, out: np.ndarray) -> None:
        """Adds each piece's expected uses under one language (p has one column) over words that occur `count` times."""
        front = self.forward(p)[2]
        n = len(self.which)
        back = np.full(front.shape, -np.inf)
        back[self.size, np.arange(n)] = 0
        last = front[self.size, np.arange(n)]
        p0 = np.log(p[:, 0])
        for i in range(len(self.steps) - 1, 0, -1):
            for m, lane, piece in self.steps[i]:
                through = back[i, lane] + p0[piece]
                np.add.at(out, piece, count[self.which[lane]] * np.exp(front[i - m, lane] + through - last[lane]))
                back[i - m, lane] = np.logaddexp(back[i - m, lane], through)


def lattices(pieces: Pieces, data: np.ndarray, offs: np.ndarray, most: int = 1 << 18) -> Iterator[Lattice]:
    """Lattices over all words of up to a stretch, in groups of similar length and bounded size."""
    size = np.diff(offs)
    order = np.argsort(size, kind="stable")
    order = order[size[order] <= STRETCH + 1]
    total = Pieces.prefix(data)
    i = 0
    while i < len(order):
        j = i + 1
        # grow while the group's table stays small and no word is twice as long as the first
        limit = np.searchsorted(size[order], 2 * size[order[i]], "right")
        j = max(j, min(int(limit), i + most // int(2 * size[order[i]] + pieces.longest)))
        own = order[i:j]
        yield Lattice(pieces, data, own, offs[own], offs[own], offs[own + 1], total)
        i = j


def _chained(last: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Log sum at the end of a word from its stretches' matrices (stretch, to, from, language) and log scales, in order."""
    state, log = np.zeros(last.shape[2:]), np.zeros(last.shape[-1])
    state[-1] = 1
    with np.errstate(divide="ignore"):
        for matrix, own in zip(last, scale, strict=True):
            # a position that no piece leads on from has no part in the scale
            weight = np.log(state) + np.where(matrix.max(0) > 0, own, -np.inf)
            most = weight.max(0)
            state = (matrix * np.exp(weight - most)).sum(1)
            top = state.max(0)
            state, log = state / top, log + most + np.log(top)
        return np.log(state[-1]) + log


def likelihoods(pieces: Pieces, data: np.ndarray, offs: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language, over all segmentations."""
    out = np.zeros((len(offs) - 1, p.shape[1]))
    for net in lattices(pieces, data, offs):
        last, scale, _ = net.forward(p)
        out[net.which] = np.log(np.maximum(last[:, -1, 0], 1e-300)) + scale[:, 0]
    total = Pieces.prefix(data)
    group = max(1, (1 << 24) // (8 * (STRETCH + pieces.longest) * pieces.longest * p.shape[1]))
    for w in np.flatnonzero(np.diff(offs) > STRETCH + 1):
        begin = np.arange(offs[w], offs[w + 1], STRETCH)
        end = np.minimum(begin + STRETCH, offs[w + 1])
        low = np.maximum(begin - pieces.longest, offs[w])
        parts = []
        for a in range(0, len(begin), group):
            s = slice(a, a + group)
            net = Lattice(pieces, data, np.arange(len(begin))[s], low[s], begin[s], end[s], total)
            last, scale, _ = net.forward(p, whole=False)
            back = np.argsort(net.which)
            parts.append((last[back], scale[back]))
        out[w] = _chained(np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts]))
    return out


def fit(samples: dict[str, list[str]], pieces: Pieces, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """The languages in order, and piece probabilities (pieces x languages), from lower-cased texts."""
    names = sorted(samples)
    p = np.full((pieces.n, len(names)), 1.0 / pieces.n)
    for c, name in enumerate(names):
        data, offs = text_bytes(pa.array(samples[name], pa.large_string()))
        word, bounds, _, _, count = words_of(data, offs, STRETCH)
        nets = list(lattices(pieces, word, bounds))
        for _ in range(rounds):
            uses = np.full(pieces.n, 0.02)
            for net in nets:
                net.expected(p[:, c : c + 1], count, uses)
            p[:, c] = uses / uses.sum()
    return names, p


def sample_texts(docs: DataFrame, train: Column, sample_bytes: int = SAMPLE_BYTES) -> dict[str, list[str]]:
    """For each language whole lower-cased training texts of about `sample_bytes`, in the order of a hash of their ids.

    A text larger than that alone is taken only if its language has no smaller one; then the smallest is.
    """
    luck = F.xxhash64(F.lit(5), F.col("doc_id"))
    size = F.octet_length("text")
    rows = docs.where(F.coalesce(train, F.lit(True)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: (r["b"], r["least"]) for r in rows.groupBy("lang").agg(F.sum(size).alias("b"), F.min(size).alias("least")).collect()}
    if not sizes:
        return {}
    part, most = F.lit(1.0), F.lit(sample_bytes)
    for name, (b, least) in sizes.items():
        part = F.when(F.col("lang") == name, F.lit(min(1.0, 3.0 * sample_bytes / max(b, 1)) if least <= sample_bytes else 1.0)).otherwise(part)
        most = F.when(F.col("lang") == name, F.lit(max(sample_bytes, least))).otherwise(most)
    drawn = rows.where((F.pmod(luck, F.lit(1 << 30)) < part * (1 << 30)) & (size <= most)).select("lang", F.lower("text").alias("text"), luck.alias("luck"))
    before = F.sum(size).over(Window.partitionBy("lang").orderBy("luck", "text").rowsBetween(Window.unboundedPreceding, 0)) - size
    out: dict[str, list[str]] = {name: [] for name in sizes}
    for r in drawn.withColumn("before", before).where(F.col("before") < sample_bytes).select("lang", "text").collect():
        out[r["lang"]].append(r["text"])
    return {k: v for k, v in out.items() if v}


def _predictor(pieces: Pieces, names: list[str], p: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column("low"))
            letters = np.asarray(batch.column("letters").fill_null(False).to_numpy(zero_copy_only=False), bool)
            like = [np.zeros((0, len(names)))]
            for _, _, d, o in chunks(data, offs, 2 << 20):
                word, bounds, inverse, of, _ = words_of(d, o)
                each = likelihoods(pieces, word, bounds, p)
                total = np.zeros((len(inverse) + 1, len(names)))
                np.cumsum(each[inverse], axis=0, out=total[1:])
                like.append(total[of[1:]] - total[of[:-1]])
            x = np.concatenate(like)
            x -= x.max(1, keepdims=True) if x.size else 0
            odds = np.exp(x)
            odds /= odds.sum(1, keepdims=True) if x.size else 1
            best = odds.argmax(1) if x.size else np.zeros(len(letters), int)
            lang = [names[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
            score = np.where(letters, odds[np.arange(len(best)), best], 0.0) if x.size else np.zeros(0)
            own = batch.column("row")
            yield pa.RecordBatch.from_arrays([*own.flatten(), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*(f.name for f in own.type), "lang_pred", "score"])
            release()

    return run


def identify(docs: DataFrame, train: Column | None = None, vocabulary_path: str = VOCABULARY, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """docs (doc_id, text, lang and any other columns) with lang_pred and score (0 to 1) for every row.

    Learnt from text and lang of the rows where `train` holds (null: it does) and lang is not null;
    a prediction looks at the text alone. score: the language's share of the text's probability.

    A text without letters, or null, is `und` with score 0; so is every text if nothing could be
    learnt. Ties go to the smaller name. Repeated rows stay. Columns named lang_pred or score are replaced.
    """
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    pieces = Pieces(vocabulary(vocabulary_path))
    names, p = fit(sample_texts(docs, F.lit(True) if train is None else train, sample_bytes), pieces)
    rows = docs.select(*own)
    if not names:
        return rows.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    # the row in a struct of its own, so that no name clashes
    seen = bounded(rows.select(F.struct(*own).alias("row"), F.lower("text").alias("low"), F.rlike("text", F.lit(r"\p{L}")).alias("letters")))
    schema = docs.select(*own).schema.add("lang_pred", "string").add("score", "double")
    return seen.mapInArrow(_predictor(pieces, names, p), schema)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def query(spark, sf_dir: str) -> DataFrame:
    """Op 9 over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"))
    seen = identify(docs, ~out)
    return seen.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "lang_pred", "score")
