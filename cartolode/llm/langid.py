"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chargrams import grams, normalise
from .common import remainder, save, small, table, text_batches

ORDER = 4
#: About so many pieces of texts, of about so many characters, of each language are learned from; an eighth of them only
#: calibrates. A model has no more n-grams of a language than that many characters hold.
TRAIN_DOCS, TRAIN_CHARS = 2000, 8_000_000
#: Longer texts are drawn from in pieces of so many characters.
PIECE = 4096
#: Cells of code points by languages that are scored at a time.
CELLS = 1 << 20
#: Texts of fewer letters are never rejected. A text's mean cost varies by its length: so many nats over its root.
SHORT, SPREAD = 20, 6.0


class Table:
    """Values by n-gram and language in sorted hash arrays: of each n-gram's hash the entries of those languages that have it."""

    def __init__(self, codes: np.ndarray, gram: np.ndarray, lang: np.ndarray, value: np.ndarray):
        """codes has a row of code points for each n-gram; entries (gram: number of the row, lang, value)."""
        width = codes.shape[1]
        h = grams(codes.ravel(), width)[::width] if width else np.zeros(1, np.uint64)
        rank = np.empty(len(h), np.int64)
        rank[np.argsort(h)] = np.arange(len(h))
        self.hash = np.sort(h)
        order = np.argsort(rank[gram], kind="stable")
        self.first = np.searchsorted(rank[gram][order], np.arange(len(h) + 1)).astype(np.int64)
        self.lang, self.value = lang[order].astype(np.uint16), value[order].astype(np.float32)

    def entries(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number in h, lang, value) of every entry that one of the hashes has."""
        at = np.searchsorted(self.hash, h)
        at[at == len(self.hash)] = 0
        seen = np.flatnonzero(self.hash[at] == h)
        n = self.first[at[seen] + 1] - self.first[at[seen]]
        entry = np.repeat(self.first[at[seen]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(seen, n), self.lang[entry], self.value[entry]


class Model:
    """log P(character | up to ORDER - 1 before it) by language; the size grows with the n-grams of all languages together."""

    def __init__(self, counts: pd.DataFrame, order: int = ORDER):
        """counts has lang, gram (order characters) and n. Lower orders count the different characters that come before."""
        self.order, self.langs = order, sorted(counts["lang"].unique())
        self.slope, self.bias, self.mean, self.limit, self.errors = 1.0, 0.0, {}, np.inf, (0.0, 0.0)
        wide = len(self.langs)
        lang = counts["lang"].map({x: k for k, x in enumerate(self.langs)}).to_numpy(np.int64)
        names, gram = np.unique(counts["gram"].to_numpy().astype(str), return_inverse=True)
        n, levels = counts["n"].to_numpy(np.float64), []
        for k in range(order, 0, -1):
            # Rows of one n-gram and language are one entry, in order of both.
            key, place = np.unique(gram * wide + lang, return_inverse=True)
            n = np.bincount(place, n)
            codes = names.view(np.uint32).reshape(len(names), -1)[:, :k] if k else np.zeros((1, 0), np.uint32)
            levels.append((codes, key // wide, key % wide, n))
            tails, tail = np.unique(np.array([x[1:] for x in names.tolist()]), return_inverse=True)
            names, gram, lang, n = tails, tail[key // wide], key % wide, np.ones(len(key))
        self.floor = float(-np.log(max(256, len(levels[-1][0]))))
        below, lower, tail_of = None, None, None
        self.gram, self.backoff = [], []
        for codes, gram, lang, n in reversed(levels):
            heads, head = np.unique(codes[:, :-1], axis=0, return_inverse=True) if codes.shape[1] > 1 else (np.zeros((1, 0), np.uint32), np.zeros(len(codes), np.int64))
            pair, of = np.unique(head.ravel()[gram] * wide + lang, return_inverse=True)
            total, kinds = np.bincount(of, n), np.bincount(of)
            once, twice = (np.bincount(lang[n == x], minlength=wide) for x in (1, 2))
            discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.9)
            backoff = discount[pair % wide] * kinds / total
            under = np.exp(self.floor)
            if below is not None:
                tails = grams(np.ascontiguousarray(codes[:, 1:]).ravel(), codes.shape[1] - 1)[:: codes.shape[1] - 1]
                tail_of = below[1][np.searchsorted(below[0], tails)]
                under = lower[1][np.searchsorted(lower[0], tail_of[gram] * wide + lang)]
            p = np.maximum(n - discount[lang], 0) / total[of] + backoff[of] * under
            self.gram.append(Table(codes, gram, lang, np.log(p)))
            self.backoff.append(Table(heads, pair // wide, pair % wide, np.log(backoff)))
            own = grams(codes.ravel(), codes.shape[1])[:: codes.shape[1]]
            below, lower = (np.sort(own), np.argsort(own)), (gram * wide + lang, p)

    def log_probs(self, codes: np.ndarray) -> np.ndarray:
        """A row for each code from number ORDER - 1 on, a column for each language. Each different n-gram is looked up once.

        From the shortest context to the longest: where a language has the n-gram its value stands, elsewhere the shorter
        context's value plus what backing off to it costs, which is nothing where the context is new.
        """
        whole = grams(codes, self.order)
        _, first, of = np.unique(whole, return_index=True, return_inverse=True)
        ends = first + self.order - 1
        out = np.full((len(first), len(self.langs)), self.floor, np.float32)
        for k in range(1, self.order + 1):
            context = grams(codes, k - 1)[ends - k + 1] if k > 1 else np.zeros(len(ends), np.uint64)
            row, lang, value = self.backoff[k - 1].entries(context)
            out[row, lang] += value
            row, lang, value = self.gram[k - 1].entries(grams(codes, k)[ends - k + 1])
            out[row, lang] = value
        return out[of]

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(letters and blanks scored, nats per one of them and language) of each text; nan where a text has no letter."""
        pad = np.full(self.order - 1, 32, np.uint32)
        total, count = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        queue, owner, size, most = [], [], 0, max(1 << 12, CELLS // max(len(self.langs), 1))

        def flush() -> None:
            nonlocal queue, owner, size
            if queue:
                lengths = np.array([len(x) for x in queue])
                score = self.log_probs(np.concatenate(queue))
                first = np.cumsum(lengths) - lengths
                # What ends in a piece's own first order - 1 codes is context only.
                ends = np.arange(self.order - 1, lengths.sum())
                own = ends - np.repeat(first, lengths)[self.order - 1 :] >= self.order - 1
                score[~own] = 0
                starts = np.maximum(first - self.order + 1, 0)
                np.add.at(total, owner, np.add.reduceat(score, starts, axis=0, dtype=np.float64))
            queue, owner, size = [], [], 0

        for i, text in enumerate(texts):
            codes = normalise(text, digits=False)[0]
            if not len(codes) or (len(codes) == 1 and codes[0] == 32):
                continue
            codes = np.concatenate([pad, codes[1:] if codes[0] == 32 else codes, pad[: int(codes[-1] != 32)]])
            count[i] = len(codes) - len(pad)
            for at in range(len(pad), len(codes), most):
                queue.append(codes[at - len(pad) : at + most])
                owner.append(i)
                size += len(queue[-1])
                if size >= most:
                    flush()
        flush()
        with np.errstate(invalid="ignore", divide="ignore"):
            return count, -total / np.where(count, count, np.nan)[:, None]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool, int, float, float]]:
        """(language, score, rejected, length, nats per character, margin to the second language) of each text."""
        count, nats = self.entropies(texts)
        out = []
        for n, row in zip(count, nats):
            if not n or not self.langs:
                out.append(("und", 0.0, True, 0, 0.0, 0.0))
                continue
            best = int(row.argmin())
            margin = float(np.partition(row, 1)[1] - row[best]) if len(row) > 1 else 1.0
            score = float(1 / (1 + np.exp(-np.clip(self.slope * margin * np.sqrt(n) + self.bias, -30, 30))))
            out.append((self.langs[best], score, self.foreign(self.langs[best], int(n), float(row[best])), int(n), float(row[best]), margin))
        return out

    def excess(self, lang: str, n: int, nats: float) -> float:
        """How far a text's cost lies above the mean of its language's texts, less what its length lets expect."""
        return nats - self.mean.get(lang, np.inf) - SPREAD / np.sqrt(n)

    def foreign(self, lang: str, n: int, nats: float) -> bool:
        return bool(n >= SHORT and self.excess(lang, n, nats) > self.limit)

    def calibrate(self, rows: pd.DataFrame) -> None:
        """Fit P(right) as a logistic function of margin times root length, and the limit beyond which a text is of no language.

        rows has, of texts that were not learned from, lang, n, own (nats in that language), other (the best of the other
        languages) and nats there. A text judged without its own language is one of an unknown language: the limit lies
        between what nearly all texts stay under in their own and what nearly all exceed in the best of the others, three
        quarters of the way, since a text lost costs more than a stray one kept; or, where these overlap, where one in a
        thousand texts of known languages is rejected. errors has the share of
        each kind that is misjudged. One right and one wrong row of margin 0 keep the fit finite.
        """
        right = rows["own"] < rows["nats"]
        x = np.append((rows["nats"] - rows["own"]).abs().clip(upper=50.0) * np.sqrt(rows["n"]), [0.0, 0.0])
        y = np.append(right.to_numpy(float), [1.0, 0.0])
        w, a = np.zeros(2), np.column_stack([x, np.ones(len(x))])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            hessian = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag([1e-2, 1e-2])
            w += np.linalg.solve(hessian, a.T @ (y - p) - 1e-2 * w)
        self.slope, self.bias = float(max(w[0], 0.0)), float(w[1])
        fit = rows[right & (rows["n"] >= SHORT)]
        self.mean = fit.groupby("lang")["own"].mean().to_dict()
        known = np.array([self.excess(r.lang, r.n, r.own) for r in fit.itertuples()])
        if not len(known):
            return
        far = np.array([self.excess(r.other, r.n, r.nats) for r in fit.itertuples() if r.other in self.mean])
        inside = float(np.quantile(known, 0.999))
        outside = float(np.quantile(far, 0.02)) if len(far) else inside + 1.0
        self.limit = inside + 0.75 * (outside - inside) if outside > inside else inside
        self.errors = (float((known > self.limit).mean()), float((far <= self.limit).mean()) if len(far) else 0.0)


def _counter(order: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pad = " " * (order - 1)
        for b in batches:
            for lang, rows in b.groupby("lang"):
                seen: dict[int, list] = {}
                for text in rows["t"]:
                    codes = normalise(text, digits=False)[0]
                    if not len(codes) or (len(codes) == 1 and codes[0] == 32):
                        continue
                    line = np.array([ord(c) for c in pad], np.uint32)
                    codes = np.concatenate([line, codes[1:] if codes[0] == 32 else codes, line[: int(codes[-1] != 32)]])
                    h, first, n = np.unique(grams(codes, order), return_index=True, return_counts=True)
                    for key, at, k in zip(h.tolist(), first.tolist(), n.tolist()):
                        if key in seen:
                            seen[key][1] += k
                        else:
                            seen[key] = ["".join(map(chr, codes[at : at + order])), k]
                if seen:
                    yield pd.DataFrame({"lang": lang, "gram": [x[0] for x in seen.values()], "n": [x[1] for x in seen.values()]})

    return count


def _scorer(shared):
    names = ["lang_pred", "score", "rejected", "n", "nats", "margin"]
    kinds = [pa.string(), pa.float64(), pa.bool_(), pa.int64(), pa.float64(), pa.float64()]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = shared.value.predict(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array([r[k] for r in rows], kinds[k]) for k in range(6))], [*b.schema.names[:-1], *names])

    return score


def _calibrator(shared):
    """Of each text (lang, t): its length, its cost in its own language, and the best of the other languages."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        place = {x: k for k, x in enumerate(model.langs)}
        for b in batches:
            langs = b.column(0).to_pylist()
            count, nats = model.entropies(b.column(1).to_pylist())
            out = []
            for lang, n, row in zip(langs, count, nats):
                if n and lang in place:
                    own, row[place[lang]] = float(row[place[lang]]), np.inf
                    out.append((lang, int(n), own, model.langs[int(row.argmin())] if len(row) > 1 else None, float(row.min())))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.float64(), pa.string(), pa.float64()))], ["lang", "n", "own", "other", "nats"])

    return rows


SCORED = "lang_pred string, score double, rejected boolean, n long, nats double, margin double"


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", train_docs: int = TRAIN_DOCS, order: int = ORDER, train_chars: int = TRAIN_CHARS) -> Model | None:
    """A calibrated model of every language of docs; None if no row has both a text with letters and a language.

    About train_docs pieces of PIECE characters of each language and train_chars characters, all if it has fewer, are drawn by
    a hash of key, text and place, equal ones once, and at least the piece of the least hash; their n-grams are counted by Spark, and all that occur are in the model. Rows without text or
    language teach nothing.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(key_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    rows = rows.where("lang is not null and t is not null")
    # Few bytes a text, in one pass each: hashes of its pieces, of which those under the language's share are drawn.
    pieces = F.sequence(F.lit(0), F.floor(F.greatest(F.length("t") - 1, F.lit(0)) / PIECE).cast("int"))
    hashed = rows.withColumn("base", F.xxhash64("k", "t", F.lit(3))).withColumn("pieces", F.transform(pieces, lambda p: F.struct(F.xxhash64("base", p).alias("h"), p.alias("p"))))
    share = F.least(F.lit(train_docs) / F.sum(F.size("pieces")), F.lit(train_chars) / F.greatest(F.sum(F.length("t")), F.lit(1)))
    shares = hashed.groupBy("lang").agg(share.alias("share"), F.min(F.array_min("pieces")["h"]).alias("least"))
    known = hashed.join(small(save(shares, "shares")), "lang")
    chosen = F.filter("pieces", lambda x: (F.pmod(x["h"], F.lit(1_000_000)) / F.lit(1e6) < F.col("share")) | (x["h"] == F.col("least")))
    each = known.select("lang", "t", "least", F.explode(chosen).alias("x")).select("lang", "x.h", (F.col("x.h") == F.col("least")).alias("first"), F.substring("t", F.col("x.p") * PIECE + 1, F.lit(PIECE)).alias("t"))
    drawn = save(each.groupBy("lang", "h").agg(F.first("t").alias("t"), F.first("first").alias("first")), "drawn")
    fit = (F.pmod(F.xxhash64("h", F.lit(4)), F.lit(8)) > 0) | F.col("first")
    counted = drawn.where(fit).select("lang", "t").mapInPandas(_counter(order), "lang string, gram string, n long")
    with text_batches(spark):
        counts = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(counts):
        return None
    model = Model(counts, order)
    shared = spark.sparkContext.broadcast(model)
    held = drawn.where(~fit).select("lang", "t").mapInArrow(_calibrator(shared), "lang string, n long, own double, other string, nats double")
    model.calibrate(held.toPandas())
    return model


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected, ...) per document: the language of least cross-entropy per character.

    `und`, score 0 and rejected where the text is null, has no letter, or there is no model. score is the calibrated
    probability that the language is right; rejected also holds for texts whose cross-entropy no training text of the
    language comes near. Rows that repeat give their results again; ids may be null; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("nats"), F.lit(0.0).alias("margin"))
    return rows.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model)), f"doc_id long, {SCORED}")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    found = identify(docs, train(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
