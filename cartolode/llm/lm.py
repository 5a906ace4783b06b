"""Language-model scoring: add-one word counts as the base, and deleted interpolation of word bigrams as the model."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import remainder, save, small, table, text_batches

#: Parts of the texts: estimates come from FIT, the weights from HELD; other texts are only scored.
FIT, HELD = 0, 1
#: Commonest words, and commonest pairs of them, whose counts every task holds. All others are counted and looked up by a
#: shuffle, so the bounds decide where a count is looked up and never what it is. No pair or word that the shuffle groups
#: holds more than a small share of all tokens.
WORDS, PAIRS = 1 << 19, 1 << 19
#: Pairs to hold are proposed by one in so many texts, and then counted in all.
SAMPLE = 16
#: Bytes of texts that a task works on at a time; a longer text is split at blanks.
PIECE = 1 << 18
#: Words are known by hashes with the lowest and the highest bit clear; those of the ends of a text no word has, as words hold
#: no blank. The highest bit marks what is a hash and no place.
RARE, INNER = np.uint64(1 << 63), np.uint64((1 << 63) - 2)
START, END = np.uint64(2), np.uint64(4)
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Of each byte its lower case, 0 for blanks and, for zero, 255, which no UTF-8 text has.
_LOWER = np.array([0 if c in b" \t\n\v\f\r" else c + 32 if 65 <= c <= 90 else c or 255 for c in range(256)], np.uint8)
_BASE = 0x9E3779B97F4A7C15


@lru_cache(2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of _BASE and of its inverse modulo 2^64, 2^bits of each."""
    each = []
    for x in (_BASE, pow(_BASE, -1, 1 << 64)):
        factors = np.full(1 << bits, x, np.uint64)
        factors[0] = 1
        each.append(np.cumprod(factors, dtype=np.uint64))
    return tuple(each)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word in lower case, and where it begins: bytes plus one are the digits of a number to the base _BASE,
    of which sums of all that stands before give each word's."""
    low = _LOWER[np.frombuffer(data, np.uint8)]
    edge = np.diff((low > 0).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(max(len(low), 1 << 12).bit_length())
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[: len(low)], out=total[1:])
    h = (total[last] - total[first]) * inverse[first]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h & INNER, first


def text_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of all texts in a row START, the hash of each word and END, and how many of them each text has."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    whole, parts, at, counts = b" ".join([*texts, b""]), [], 0, np.zeros(len(texts), np.int64)
    while at < len(whole):
        cut = SPACE.search(whole, at + PIECE)
        end = cut.start() + 1 if cut else len(whole)
        h, first = word_hashes(whole[at:end])
        counts += np.bincount(np.searchsorted(ends, first + at, side="right"), minlength=len(texts))
        parts.append(h)
        at = end
    counts += 2
    stop = np.cumsum(counts)
    out = np.full(int(stop[-1]), START)
    out[stop - 1] = END
    inner = np.ones(len(out), bool)
    inner[stop - 1] = inner[stop - counts] = False
    out[inner] = np.concatenate(parts)
    return out, counts


def token_hashes(text: bytes | None) -> np.ndarray:
    return text_hashes([text or b""])[0]


class Sorted:
    """Numbers of uniformly spread keys in a sorted array, looked up from where the keys of their highest bits begin."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64((1 << 64) - 1))
        bits = max(1, len(keys)).bit_length()
        self.shift = np.uint64(64 - bits)
        self.begin = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each, -1 for those that are no keys."""
        at = self.begin[(wanted >> self.shift).astype(np.int64)]
        left = np.flatnonzero(self.keys[at] < wanted)
        while len(left):
            at[left] += 1
            left = left[self.keys[at[left]] < wanted[left]]
        return np.where(self.keys[at] == wanted, at, -1).astype(np.int64)


class Block:
    """The tokens of some whole texts in a row: of each token its hash and the number of its text in the block."""

    def __init__(self, rows: list[tuple], texts: list[bytes]):
        self.rows = rows
        self.hash, counts = text_hashes(texts)
        self.text = np.repeat(np.arange(len(texts)), counts)
        self.part = np.array([r[0] for r in rows])
        #: Places of the tokens that are predicted; the one before each is its context.
        self.at = np.flatnonzero(self.hash != START)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of the rows (part, ..., t)."""
    rows, texts, size = [], [], 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns[:-1]), b.columns[-1]):
            rows.append(row[:-1])
            texts.append(row[-1].as_py() or b"")
            size += len(texts[-1])
            if size >= PIECE:
                yield Block(rows, texts)
                rows, texts, size = [], [], 0
    if rows:
        yield Block(rows, texts)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _blocks(batches):
        word, which = np.unique(b.hash[b.at], return_inverse=True)
        held = b.part[b.text[b.at]] == HELD
        counts = [np.bincount(which[x], minlength=len(word)) for x in (~held, held)]
        yield pa.RecordBatch.from_arrays([_signed(word), *map(pa.array, counts)], ["h", "fit", "held"])


#: Spreads the codes of pairs over all 64 bits, each to another number.
MIX = np.uint64(0xBF58476D1CE4E5B9)


class Counts:
    """The commonest words and START in order of their hashes, and the held pairs of them in order of their codes; a code is
    the place of the first word times 2^20 and that of the second."""

    def __init__(self, hashes: np.ndarray, fit: np.ndarray, held: np.ndarray):
        order = np.argsort(hashes)
        self.word, self.fit, self.held = Sorted(hashes[order] << np.uint64(1)), fit[order], held[order]
        self.hold(np.zeros(0, np.int64))

    def hold(self, codes: np.ndarray) -> None:
        """Hold these pairs."""
        mixed = codes.astype(np.uint64) * MIX
        order = np.argsort(mixed)
        self.pair, self.mixed, self.pair_fit = codes[order], Sorted(mixed[order]), np.zeros(len(codes), np.int64)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word, -1 for those that are not held."""
        return self.word.find(hashes << np.uint64(1))

    def pairs(self, b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each predicted token of b the places of its context and of itself, and the code of both or -1."""
        place = self.places(b.hash)
        one, two = place[b.at - 1], place[b.at]
        return one, two, np.where((one >= 0) & (two >= 0), one << 20 | two, -1)

    def find(self, code: np.ndarray) -> np.ndarray:
        """The number of the held pair of each code, -1 for others."""
        at = self.mixed.find(code.astype(np.uint64) * MIX)
        return np.where(code >= 0, at, -1)


def _propose_pairs(shared) -> Callable:
    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            code, n = np.unique(shared.value.pairs(b)[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code[code >= 0]), pa.array(n[code >= 0])], ["code", "n"])

    return propose


def _count_pairs(shared) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        total = np.zeros((2, len(v.pair)), np.int64)
        for b in _blocks(batches):
            at = v.find(v.pairs(b)[2])
            held = b.part[b.text[b.at]] == HELD
            for k, of in enumerate((~held, held)):
                total[k] += np.bincount(at[of & (at >= 0)], minlength=len(v.pair))
        some = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0, some]), pa.array(total[1, some])], ["pair", "fit", "held"])

    return count


ASKED = "key long, sub long, doc long, rest int"


def _ask(shared) -> Callable:
    """A row for each predicted token whose pair is not held, to be counted and looked up by key and sub.

    Two held words: key is their code. Else key is the hash of the word that is not held, of the predicted one if neither is,
    and sub the other word, by its place or, if it is not held either, its hash; the lowest bit tells whether key is the
    context. rest is how often the text has the pair times four, and the part plus one.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in _blocks(batches):
            one, two, code = v.pairs(b)
            text = b.text[b.at]
            apart = (code >= 0) & (v.find(code) < 0)
            # In order of the texts, so that rows of one text follow each other, which shuffles well.
            pair, m = np.unique(text[apart].astype(np.uint64) << np.uint64(40) | code[apart].astype(np.uint64), return_counts=True)
            rare = np.flatnonzero(code < 0)
            own = two[rare] < 0
            first, second = b.hash[b.at[rare] - 1], b.hash[b.at[rare]]
            key = np.concatenate([pair & np.uint64((1 << 40) - 1), np.where(own, second, first) | RARE])
            other = np.where(own, one[rare], two[rare])
            sub = np.concatenate([np.zeros(len(pair), np.uint64), np.where(other < 0, first | RARE, other.astype(np.uint64) << np.uint64(1) | ~own)])
            of = np.concatenate([(pair >> np.uint64(40)).astype(np.int64), text[rare]])
            rest = np.concatenate([m, np.ones(len(rare), np.int64)]) << 2 | b.part[of] + 1
            doc = np.array([r[1] for r in b.rows], np.int64)[of]
            yield pa.RecordBatch.from_arrays([_signed(key), _signed(sub), pa.array(doc), pa.array(rest.astype(np.int32))], ["key", "sub", "doc", "rest"])

    return ask


def bucket(counts: np.ndarray) -> np.ndarray:
    """The bit length of each count."""
    return np.frexp(np.asarray(counts, np.float64))[1] * (np.asarray(counts) > 0)


def learn_weights(b: np.ndarray, p2: np.ndarray, p1: np.ndarray, n: np.ndarray, uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights of (bigram, unigram, uniform) by context bucket, by expectation-maximisation on held-out events: n events each
    of a bucket, a bigram and a unigram probability.

    Every bucket starts from one event spread over the three, which is all that empty buckets have. Contexts that were never
    seen say nothing of what follows, so the bigram has no weight in bucket 0.
    """
    weights = np.full((65, 3), 1 / 3)
    if len(b):
        each = np.column_stack([p2, p1, np.full(len(b), uniform)])
        for _ in range(rounds):
            share = weights[b] * each
            share *= (n / share.sum(1))[:, None]
            new = np.full((65, 3), 1 / 3)
            np.add.at(new, b, share)
            weights = new / new.sum(1, keepdims=True)
    weights[0, 0] = 0
    weights[0] /= weights[0].sum()
    return weights


class Model:
    """The counts that every task holds, totals, and the weights of the mixture."""

    def __init__(self, counts: Counts, tokens: int, words: int, fit_tokens: int):
        self.counts, self.tokens, self.words, self.fit_tokens = counts, tokens, words, max(fit_tokens, 1)
        self.uniform = 1 / (words + 1)
        self.learn(np.zeros(0, np.int64), np.zeros(0, np.int64))

    def logp(self, pair: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 of the mixture for counts of the pair, of its context and of its word."""
        w = self.weights[bucket(context)]
        return np.log10(w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / self.fit_tokens + w[:, 2] * self.uniform)

    def cells(self, context: np.ndarray, pair: np.ndarray, word: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Events by cell: the bucket, and both probabilities to 1/STEPS of an octave. At most some thousand cells a bucket,
        however many events: the weights follow no finer differences."""
        step = lambda p: np.where(p > 0, np.round(-STEPS * np.log2(np.where(p > 0, p, 1.0))), 1023).astype(np.int64)
        cell = bucket(context).astype(np.int64) << 20 | step(pair / np.maximum(context, 1)) << 10 | step(word / self.fit_tokens)
        cell, which = np.unique(cell, return_inverse=True)
        return cell, np.bincount(which, m, len(cell)).astype(np.int64)

    def learn(self, cell: np.ndarray, m: np.ndarray) -> None:
        p = lambda x: np.where(x == 1023, 0.0, 2.0 ** (-x / STEPS))
        order = np.argsort(cell, kind="stable")
        cell, m = cell[order], m[order]
        self.weights = learn_weights(cell >> 20, p(cell >> 10 & 1023), p(cell & 1023), m, self.uniform)

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 1) / (self.tokens + self.words + 1))


SCORED = "doc long, doc_id long, n_tokens long, n_known long, base double, score double"


def _score(shared) -> Callable:
    """Scores of the rows (part, doc, doc_id, t) by what tasks hold. Of pairs and words that they do not hold it is assumed
    that no other text of FIT has them, as stands in _assumed; what was looked up is put right afterwards."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        v = model.counts
        for b in _blocks(batches):
            one, two, code = v.pairs(b)
            text = b.text[b.at]
            fit, learned = b.part[text] == FIT, b.part[text] >= 0
            own = np.zeros(len(code), np.int64)
            apart = np.flatnonzero(code >= 0)
            _, which, n = np.unique(code[apart].astype(np.uint64) << np.uint64(20) | text[apart].astype(np.uint64), return_inverse=True, return_counts=True)
            own[apart] = n[which]
            own[code < 0] = 1
            at = v.find(code)
            pair = np.where(at >= 0, v.pair_fit[at] if len(v.pair) else 0, np.where(fit, own, 0))
            context, word = np.where(one >= 0, v.fit[one], fit), np.where(two >= 0, v.fit[two], fit)
            every = np.where(two >= 0, v.fit[two] + v.held[two], learned)
            logp = model.logp(pair, context, word)
            # Where neither word is held the whole is looked up.
            logp[(one < 0) & (two < 0)] = 0
            sums = [np.bincount(text, x, len(b.rows)) for x in (np.ones(len(text)), every > 0, model.base(every), logp)]
            rows = [[r[1] for r in b.rows], [r[2] for r in b.rows], *(np.round(x).astype(np.int64) for x in sums[:2]), *sums[2:]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k < 4 else pa.float64()) for k, x in enumerate(rows)], [x.split()[0] for x in SCORED.split(", ")])

    return score


def _commonest(counts: DataFrame, limit: int) -> DataFrame:
    """The rows above the lowest n that at most limit rows reach, n being taken in steps of a 32nd of an octave. Only a
    histogram of at most 2,016 steps and the rows themselves reach the driver."""
    counts = counts.withColumn("step", F.floor(32 * F.log2("n")))
    total, least = 0, None
    for step, rows in counts.groupBy("step").count().orderBy(F.desc("step")).collect():
        total += rows
        if total > limit:
            break
        least = step
    return counts.where(F.col("step") >= (least if least is not None else 1 << 20)).drop("step")


def _held_counts(learned: DataFrame, words: DataFrame, texts: tuple[int, int]) -> tuple[Counts, list]:
    """The counts that tasks hold, and the held-out events of the held pairs as (context, pair, word) counts and number."""
    spark = learned.sparkSession
    top = _commonest(words.withColumn("n", F.col("fit") + F.col("held")), WORDS).toArrow()
    ends = np.array([START, END], np.uint64)
    hashes, fit, held = top.column("h").to_numpy().view(np.uint64), top.column("fit").to_numpy(), top.column("held").to_numpy()
    keep = ~np.isin(hashes, ends)
    v = Counts(np.append(hashes[keep], ends), *(np.append(x[keep], [n, n]).astype(np.int64) for x, n in zip((fit, held), texts)))
    shared = spark.sparkContext.broadcast(v)
    rows = learned.select("part", "t")
    proposed = rows.where(F.pmod(F.xxhash64("t"), F.lit(SAMPLE)) == 0).mapInArrow(_propose_pairs(shared), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    shared.unpersist()
    v.hold(_commonest(save(proposed.where("n > 1"), "proposed"), PAIRS).select("code").toArrow().column(0).to_numpy())
    shared = spark.sparkContext.broadcast(v)
    counted = rows.mapInArrow(_count_pairs(shared), "pair long, fit long, held long").groupBy("pair").agg(F.sum("fit").alias("fit"), F.sum("held").alias("held")).toArrow()
    shared.unpersist()
    total = np.zeros((2, len(v.pair)), np.int64)
    total[:, counted.column("pair").to_numpy()] = [counted.column(k).to_numpy() for k in ("fit", "held")]
    v.pair_fit = total[0]
    seen = np.flatnonzero(total[1])
    return v, [v.fit[v.pair[seen] >> 20], total[0, seen], v.fit[v.pair[seen] & ((1 << 20) - 1)], total[1, seen]]


def _looked_up(rows: DataFrame, words: DataFrame, v: Counts) -> DataFrame:
    """The rows of _ask with what was counted over all texts, those left out where all was as _score assumes: (key, sub, doc,
    rest, pair, n, every, context), context being the count of a context where neither word is held."""
    spark = rows.sparkSession
    asked = rows.select("part", "doc", "t").mapInArrow(_ask(spark.sparkContext.broadcast(v)), ASKED).repartition("key")
    part, rare = F.col("rest").bitwiseAND(F.lit(3)) - 1, F.col("key") < 0
    m = F.shiftright("rest", 2)
    fit, predicted = F.when(part == FIT, m).otherwise(0), F.col("sub").bitwiseAND(F.lit(1)) == 0
    by_key = Window.partitionBy("key")
    counted = asked.withColumns({
        "pair": F.sum(fit).over(Window.partitionBy("key", "sub")),
        "n": F.sum(F.when(rare & predicted, fit)).over(by_key),
        "every": F.sum(F.when(rare & predicted & (part >= 0), m)).over(by_key),
    })
    one = F.when(part == FIT, 1).otherwise(0)
    alone = F.col("sub") < 0
    as_assumed = (part != HELD) & ~alone & (F.col("pair") == fit) & (~rare | ((F.coalesce("n", F.lit(0)) == one) & (F.coalesce("every", F.lit(0)) == one)))
    kept = save(counted.where(~as_assumed), "looked-up")
    context = words.select(F.col("h").bitwiseOR(F.lit(-(1 << 63))).alias("sub"), F.col("fit").alias("context"))
    return kept.where(~alone).withColumn("context", F.lit(None).cast("long")).unionByName(kept.where(alone).join(context, "sub", "left"))


class Found:
    """A batch of _looked_up: of each row its part, how often it counts, the counts of pair, context and word and of the word
    in all parts, and what _score assumed of them."""

    def __init__(self, b: pa.RecordBatch, v: Counts):
        column = lambda k: pc.fill_null(b.column(k), 0).to_numpy()
        key, sub, rest, self.doc = column("key"), column("sub"), column("rest"), b.column("doc")
        rare, predicted, self.neither = key < 0, sub & 1 == 0, sub < 0
        self.part, self.m = (rest & 3) - 1, rest >> 2
        other = np.where(self.neither, 0, sub >> 1)
        first, second = v.fit[np.where(rare, other, key >> 20)], v.fit[np.where(rare, other, key & (1 << 20) - 1)]
        n = column("n")
        self.pair = column("pair")
        self.context = np.where(self.neither, column("context"), np.where(rare & ~predicted, n, first))
        self.word = np.where(rare & predicted, n, second)
        one = (self.part == FIT).astype(np.int64)
        self.was_pair = np.where(rare, one, one * self.m)
        self.was_context, self.was_word = np.where(rare & ~predicted, one, first), np.where(rare & predicted, one, second)
        self.new, self.every = rare & predicted, column("every")


def _changes(shared) -> Callable:
    """What the rows found change in the sums of their texts."""

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            x = Found(b, model.counts)
            score = x.m * (model.logp(x.pair, x.context, x.word) - np.where(x.neither, 0.0, model.logp(x.was_pair, x.was_context, x.was_word)))
            one = (x.part >= 0).astype(np.int64)
            base = np.where(x.new, model.base(x.every) - model.base(one), 0.0)
            known = np.where(x.new, (x.every > 0).astype(np.int64) - one, 0)
            yield pa.RecordBatch.from_arrays([x.doc, pa.array(score), pa.array(base), pa.array(known)], ["doc", "more_score", "more_base", "more_known"])

    return changes


#: Parts of an octave that probabilities of held-out events are told apart by.
STEPS = 16


def _cell_counts(shared) -> Callable:
    """Held-out events by bucket and by the logarithms of both probabilities to a part of an octave."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            x = Found(b, model.counts)
            held = x.part == HELD
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in model.cells(x.context[held], x.pair[held], x.word[held], x.m[held])], ["cell", "m"])

    return count


def fit_and_score(docs: DataFrame, part: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Model]:
    """score_texts' result, and the model."""
    with text_batches(docs.sparkSession):
        return _fit_and_score(docs, part, id_col, text_col)


def _fit_and_score(docs: DataFrame, part: Column, id_col: str, text_col: str) -> tuple[DataFrame, Model]:
    spark = docs.sparkSession
    text = F.col(text_col).cast("string").cast("binary")
    rows = docs.select(F.when(part.isin(FIT, HELD), part).otherwise(-1).cast("byte").alias("part"), F.col(id_col).cast("long").alias("doc_id"), text.alias("t"))
    rows = rows.withColumn("doc", F.xxhash64("part", "doc_id", "t"))
    learned = rows.where("part >= 0")
    words = learned.select("part", "t").mapInArrow(_count_words, "h long, fit long, held long").groupBy("h").agg(F.sum("fit").alias("fit"), F.sum("held").alias("held"))
    words = save(words, "words")
    n, fit_n, v = words.agg(F.coalesce(F.sum(F.col("fit") + F.col("held")), F.lit(0)), F.coalesce(F.sum("fit"), F.lit(0)), F.count("*")).first()
    ends = words.where(F.col("h") == int(END)).select("fit", "held").first()
    counts, events = _held_counts(learned, words, tuple(ends) if ends else (0, 0))
    model = Model(counts, n, v, fit_n)
    found = _looked_up(rows, words, counts)
    shared = spark.sparkContext.broadcast(model)
    held = found.where(F.col("rest").bitwiseAND(F.lit(3)) == HELD + 1)
    cells = held.mapInArrow(_cell_counts(shared), "cell long, m long").groupBy("cell").agg(F.sum("m").alias("m")).toArrow()
    shared.unpersist()
    model.learn(*(np.concatenate([cells.column(k).to_numpy(), x]) for k, x in zip(("cell", "m"), model.cells(*events))))
    shared = spark.sparkContext.broadcast(model)
    scored = save(rows.select("part", "doc", "doc_id", "t").mapInArrow(_score(shared), SCORED), "scored")
    change = found.mapInArrow(_changes(shared), "doc long, more_score double, more_base double, more_known long")
    change = change.groupBy("doc").agg(*[F.sum(c).alias(c) for c in ("more_score", "more_base", "more_known")])
    # Rows that repeat, id and all, share a key and were each looked up: what is found is theirs in equal parts.
    copies = save(scored.groupBy("doc").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    change = change.join(small(copies), "doc", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b) / F.coalesce("copies", F.lit(1)), F.lit(0)))
    joined = scored.join(change, "doc", "left")
    return joined.select(
        "doc_id", "n_tokens", plus("n_known", "more_known").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        plus("base", "more_base").alias("base_score"), plus("score", "more_score").alias("score"),
    ), model


def score_texts(docs: DataFrame, part: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) per document of docs.

    part says what each row is for: FIT and HELD rows are learned from, others (or null) only scored. base_score adds one to
    each word's count over both. The model mixes the maximum-likelihood estimates of word bigrams and words, both from FIT,
    and the uniform distribution over all known words and one more for the unknown; the weights depend on how often the
    context occurred in FIT, by powers of two, and are learned by expectation-maximisation on the bigrams of HELD. Words are
    known by 64-bit hashes.

    Null texts are empty and have the end as only token; rows that repeat are scored again and counted again; ids may be
    null; other columns are ignored; with nothing to learn from every word is unseen; an empty table gives no rows.
    """
    return fit_and_score(docs, part, id_col, text_col)[0]


def op7_deleted_interpolation(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    left = remainder(F.col("doc_id"), 7)
    part = F.when(left == 3, HELD).when(left != 2, FIT)
    scored = score_texts(docs, part)
    return scored.select("doc_id", (left == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
