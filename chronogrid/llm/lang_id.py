"""Language ID: interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

Spark counts the character 4-grams of every training text, and from them builds a table for each order: a gram's hash with
its log probability in every language. A 4-gram seen in one language only has its backed-off probability in the others, so
one search gives a character's score in all languages. The tables keep every gram and grow with the training texts; tasks
hold them as sorted hash arrays, slice by slice. A gram, its suffixes and their contexts all hold the gram's last character
but one, and slices are made by that character, so a slice needs nothing of another. A text gets the language of the lowest
length-normalised cross-entropy, and is rejected if that lies above what texts of the language reach in training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogrid.llm.common import free_name, held_out
from chronogrid.shared import materialise

ORDER = 4
#: Bytes of the model that tasks hold at once; a larger model is applied in slices, one pass over the texts for each.
SLICE_BYTES = 64 << 20
MAX_LANGS = 512
#: One text in so many is kept from the counts, to calibrate rejection.
LEFT_OUT = 10
#: Distinct texts left out from which a language has its own limit for rejection.
CALIBRATION_TEXTS = 50
#: Characters handled at once in a task; longer texts are read in pieces.
PIECE = 1 << 19
UNKNOWN = "und"
#: Log probability of a character that no text has: one of 65,536.
FLOOR = float(-np.log(1 << 16))
#: Nats above the calibrated cross-entropy up to which a text is accepted.
MARGIN = 0.5


def _letters() -> np.ndarray:
    """For each code point up to U+FFFF itself if it is a letter, else a space."""
    held = getattr(_letters, "held", None)
    if held is None:
        held = np.array([c if chr(c).isalpha() else 32 for c in range(1 << 16)], dtype=np.uint64)
        _letters.held = held
    return held


def _held(text: str) -> np.ndarray:
    """A lower-cased letter or a space for each character."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    high = points > 0xFFFF
    held = _letters()[np.minimum(points, 0xFFFF)]
    if high.any():
        held[high] = [0xFFFD if chr(int(p)).isalpha() else 32 for p in points[high]]
    return held


def _codes(text: str) -> np.ndarray:
    """Lower-cased letters with one space for each run of anything else, three before and one after; empty if no letter.

    Letters above U+FFFF stand as U+FFFD, so four codes fill a 64-bit hash exactly.
    """
    held = _held(text)
    letter = held != 32
    if not letter.any():
        return np.zeros(0, dtype=np.uint64)
    held = _spaced(held, letter, False)
    return np.concatenate([np.full(3, 32, np.uint64), held, np.full(1 if held[-1] != 32 else 0, 32, np.uint64)])


def _spaced(held: np.ndarray, letter: np.ndarray, after_letter: bool) -> np.ndarray:
    """Letters, and one space where anything else follows a letter."""
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] |= after_letter
    return held[keep]


def _grams(codes: np.ndarray) -> np.ndarray:
    """The hash of every 4-gram: its four 16-bit codes side by side."""
    if len(codes) < ORDER:
        return np.zeros(0, dtype=np.uint64)
    s = np.uint64(16)
    return ((codes[:-3] << s | codes[1:-2]) << s | codes[2:-1]) << s | codes[3:]


def _pieces(text: str, size: int) -> Iterator[str]:
    """Parts of at most ``size`` characters, cut after the last space of each if there is one in its last half: lower-casing
    looks at a word's neighbours."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            space = text.rfind(" ", at + size // 2, end)
            end = space + 1 if space >= 0 else end
        yield text[at:end]
        at = end


def _text_grams(texts, size: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, grams) piece by piece; three codes are carried over, so pieces give the grams of the whole."""
    for i, text in enumerate(texts):
        if text and len(text) <= size:
            yield i, _grams(_codes(text))
            continue
        last = np.full(3, 32, np.uint64)
        for piece in _pieces(text or "", size):
            held = _held(piece)
            held = _spaced(held, held != 32, bool(last[-1] != 32))
            if len(held):
                codes = np.concatenate([last, held])
                last = codes[-3:]
                yield i, _grams(codes)
        if last[-1] != 32:
            yield i, _grams(np.r_[last, np.uint64(32)])


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial (lang, gram, n) of each batch."""
    for pdf in batches:
        for lang, part in pdf.groupby("lang", sort=False):
            held, n = [], 0
            texts = list(part["text"])
            for _, grams in _text_grams(texts):
                held.append(grams)
                n += len(grams)
                if n > 4 * PIECE:
                    yield _counted(lang, held)
                    held, n = [], 0
            if held:
                yield _counted(lang, held)


def _counted(lang: str, held: list[np.ndarray]) -> pd.DataFrame:
    keys, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return pd.DataFrame({"lang": lang, "gram": keys.astype(np.int64), "n": n})


@dataclass
class Slice:
    """Part ``number`` of ``of`` of a model as arrays, sorted by hash."""

    langs: int
    number: int = 0
    of: int = 1
    #: per order 4..1: hashes, log probabilities [hash, language]
    keys: dict[int, np.ndarray] = field(default_factory=dict)
    logp: dict[int, np.ndarray] = field(default_factory=dict)
    #: per order: hashes of contexts (order 1: the one empty context, 0), log back-off weights [context, language]
    contexts: dict[int, np.ndarray] = field(default_factory=dict)
    back: dict[int, np.ndarray] = field(default_factory=dict)

    def _find(self, table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, key), max(len(table) - 1, 0))
        return at, table[at] == key if len(table) else np.zeros(len(key), dtype=bool)

    def log_probs(self, key: np.ndarray, order: int = ORDER) -> np.ndarray:
        """[gram, language]; what no language has seen backs off to the next order with the context's weight."""
        if order == 0:
            return np.full((len(key), self.langs), FLOOR, dtype=np.float32)
        at, seen = self._find(self.keys[order], key)
        out = self.logp[order][at] if len(self.keys[order]) else np.zeros((len(key), self.langs), np.float32)
        if not seen.all():
            miss = ~seen
            rest = key[miss]
            lower = self.log_probs(rest & np.uint64(_mask(order - 1)), order - 1)
            c, known = self._find(self.contexts[order], rest >> np.uint64(16))
            if known.any():
                lower[known] += self.back[order][c[known]]
            out[miss] = lower
        return out

    def sums(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(log probability of this slice's characters [text, language], their number)."""
        total = np.zeros((len(texts), self.langs))
        count = np.zeros(len(texts), dtype=np.int64)
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        most = max(1 << 12, PIECE // max(1, self.langs // 4))

        def flush() -> None:
            nonlocal held, size
            if held:
                key = np.concatenate([g for _, g in held])
                of = np.repeat([i for i, _ in held], [len(g) for _, g in held])
                for at in range(0, len(key), most):
                    scores, own = self.log_probs(key[at : at + most]), of[at : at + most]
                    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    np.add.at(total, own[first], np.add.reduceat(scores, first, axis=0, dtype=np.float64))
            held, size = [], 0

        for i, g in _text_grams(texts):
            if self.of > 1:
                g = g[_slice_of(g, self.of) == self.number]
            if len(g):
                held.append((i, g))
                count[i] += len(g)
                size += len(g)
                if size >= most:
                    flush()
        flush()
        return total, count


def _mask(order: int) -> int:
    return (1 << 16 * order) - 1


def _slice_of(key, of: int):
    """The slice of grams, by the last character but one; for numpy arrays and for columns alike."""
    if isinstance(key, Column):
        return F.shiftrightunsigned(key, 16).bitwiseAND(F.lit(0xFFFF)) * 40503 % 65536 % of
    return (key >> np.uint64(16) & np.uint64(0xFFFF)) * np.uint64(40503) % np.uint64(65536) % np.uint64(of)


@dataclass
class Model:
    """Tables of the language models; limits: by language the cross-entropy from which a text is rejected."""

    langs: list[str]
    #: per order 1..4: (key, logp) and (key, back), one array entry for each language
    grams: dict[int, DataFrame] = field(default_factory=dict)
    contexts: dict[int, DataFrame] = field(default_factory=dict)
    slices: int = 1
    limits: list[float] | None = None

    def load(self, number: int) -> Slice:
        out = Slice(len(self.langs), number, self.slices)
        for order in range(1, ORDER + 1):
            part = self.grams[order]
            if order > 1 and self.slices > 1:
                part = part.filter(_slice_of(F.col("key"), self.slices) == number)
            out.keys[order], out.logp[order] = self._arrays(part, "logp")
            part = self.contexts[order]
            if order > 1 and self.slices > 1:
                part = part.filter(_slice_of(F.shiftleft("key", 16), self.slices) == number)
            out.contexts[order], out.back[order] = self._arrays(part, "back")
        return out

    def _arrays(self, part: DataFrame, name: str) -> tuple[np.ndarray, np.ndarray]:
        pdf = part.select("key", name).toPandas()
        keys = pdf["key"].to_numpy(np.int64).astype(np.uint64)
        order = np.argsort(keys)
        values = np.stack(pdf[name].to_list()).astype(np.float32) if len(pdf) else np.zeros((0, len(self.langs)), np.float32)
        return keys[order], values[order]


def _by_language(rows: DataFrame, names: list[str], langs: int) -> DataFrame:
    """(key, an array by language for each name, 0 where a language has none) from (l, key, names)."""
    held = rows.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("l", F.struct(*names)))).alias("m"))
    slots = F.sequence(F.lit(0), F.lit(langs - 1))

    def values(name: str) -> Column:
        return F.transform(slots, lambda i: F.coalesce(F.try_element_at("m", i)[name].cast("double"), F.lit(0.0))).alias(name)

    return held.select("key", *map(values, names))


def _interpolated(cut: Column):
    """Functions of a language's place from 1: a gram's log probability, and a context's log back-off weight."""

    def weight(i: Column) -> Column:
        total = F.element_at("total", i)
        return F.when(total > 0, F.log(F.element_at(cut, i) * F.element_at("kinds", i) / total)).otherwise(0.0)

    def share(i: Column) -> Column:
        total, low = F.element_at("total", i), F.element_at("low", i)
        own = F.greatest(F.element_at("n", i) - F.element_at(cut, i), F.lit(0.0)) / total
        return F.when(total > 0, F.log(own + F.exp(weight(i) + low))).otherwise(low)

    return share, weight


def build_model(counts: DataFrame, langs: list[str], slice_bytes: int = SLICE_BYTES) -> Model:
    """counts: (lang, gram, n). Interpolated Kneser-Ney with one discount for each order and language."""
    model, size = Model(langs), len(langs)
    numbers = counts.sparkSession.createDataFrame([(x, i) for i, x in enumerate(langs)], "lang string, l int")
    rows = {ORDER: counts.join(F.broadcast(numbers), "lang").select("l", F.col("gram").alias("key"), "n")}
    for order in range(ORDER - 1, 0, -1):  # continuation counts: by how many characters a gram is preceded
        suffix = F.col("key").bitwiseAND(F.lit(_mask(order)))
        rows[order] = materialise(rows[order + 1].groupBy("l", suffix.alias("key")).agg(F.count("*").alias("n")))
    volume = 0
    for order in range(1, ORDER + 1):
        seen = {r["l"]: (r["once"], r["twice"]) for r in rows[order].groupBy("l").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect()}
        cuts = [min(0.95, max(0.1, a / (a + 2 * b))) if a and b else 0.75 for a, b in (seen.get(i, (0, 0)) for i in range(size))]
        cut = F.array(*map(F.lit, cuts))
        context = F.shiftrightunsigned("key", 16) if order > 1 else F.lit(0).cast("long")
        sums = rows[order].groupBy("l", context.alias("key")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        sums = materialise(_by_language(sums, ["total", "kinds"], size))
        own = _by_language(rows[order], ["n"], size).withColumn("context", context)
        around = sums.withColumnRenamed("key", "context")
        own = own.join(F.broadcast(around) if order == 1 else around, "context")
        if order > 1:
            lower = model.grams[order - 1].select(F.col("key").alias("suffix"), F.col("logp").alias("low"))
            own = own.withColumn("suffix", F.col("key").bitwiseAND(F.lit(_mask(order - 1)))).join(lower, "suffix")
        else:
            own = own.withColumn("low", F.array_repeat(F.lit(FLOOR), size))
        share, weight = _interpolated(cut)
        slots = F.sequence(F.lit(1), F.lit(size))
        model.grams[order] = materialise(own.select("key", F.transform(slots, share).alias("logp")))
        model.contexts[order] = sums.select("key", F.transform(slots, weight).alias("back"))
        if order > 1:
            volume += (model.grams[order].count() + sums.count()) * (8 + 4 * size)
    model.slices = max(1, -(-volume // slice_bytes))
    return model


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", slice_bytes: int = SLICE_BYTES) -> Model:
    """Models of the rows of train with a language and a text; rejection is calibrated on the tenth of the texts, by their
    hash, that the models do not count. An empty table gives a model without languages; repeated rows count as often."""
    rows = train.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    aside = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(LEFT_OUT)) == 0
    rows, left_out = rows.filter(~aside), rows.filter(aside)
    counts = materialise(rows.mapInPandas(_count_batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not langs:
        return Model([])
    model = build_model(counts, langs, slice_bytes)
    _calibrate(model, left_out)
    return model


def _summing(held):
    @F.pandas_udf("struct<p:array<double>,n:long>")
    def look(texts: pd.Series) -> pd.DataFrame:
        p, n = held.value.sums(list(texts))
        return pd.DataFrame({"p": list(p), "n": n})

    return look


def _with_sums(docs: DataFrame, model: Model, text_col: str, sums: str) -> DataFrame:
    """docs with the column ``sums``: struct of log probabilities by language and the characters scored."""
    context = docs.sparkSession.sparkContext
    if model.slices == 1:
        return docs.withColumn(sums, _summing(context.broadcast(model.load(0)))(F.col(text_col)))
    # the texts are written once; a slice adds a narrow table of a row's number and its sums
    row = free_name(docs, sums + "_row")
    docs = materialise(docs.withColumn(row, F.monotonically_increasing_id()))
    parts = []
    for number in range(model.slices):
        held = context.broadcast(model.load(number))
        seen = _summing(held)(F.col(text_col))
        parts.append(materialise(docs.select(row, F.lit(number).alias("number"), seen.alias("s")).filter("s.n > 0")))
        held.destroy()
    each = F.array_sort(F.collect_list(F.struct("number", "s")))
    none = F.array_repeat(F.lit(0.0), len(model.langs))
    added = reduce(DataFrame.unionAll, parts).groupBy(row).agg(each.alias("each"))
    p = F.aggregate("each", none, lambda a, x: F.zip_with(a, x["s"]["p"], lambda b, c: b + c))
    n = F.aggregate("each", F.lit(0).cast("long"), lambda a, x: a + x["s"]["n"])
    added = added.select(row, F.struct(p.alias("p"), n.alias("n")).alias(sums))
    empty = F.struct(none.alias("p"), F.lit(0).cast("long").alias("n"))
    return docs.join(added, row, "left").withColumn(sums, F.coalesce(sums, empty)).drop(row)


def _entropies(sums: str) -> Column:
    return F.transform(f"{sums}.p", lambda p: -p / F.greatest(F.col(f"{sums}.n"), F.lit(1)))


def _calibrate(model: Model, rows: DataFrame) -> None:
    """For each language the cross-entropy that 99.5 % of its distinct texts of 64 characters or more left out stay under,
    plus a margin; with fewer than CALIBRATION_TEXTS of them the greatest of the others."""
    seen = _with_sums(rows, model, "text", "s").filter("s.n >= 64")
    low = seen.select("lang", F.xxhash64("text").alias("h"), F.array_min(_entropies("s")).alias("e")).dropDuplicates(["lang", "h"])
    got = low.groupBy("lang").agg(F.count("*").alias("n"), F.percentile_approx("e", 0.995, 10_000).alias("e")).collect()
    by = {r["lang"]: r["e"] for r in got if r["n"] >= CALIBRATION_TEXTS}
    rest = max((r["e"] for r in got), default=float("inf"))
    model.limits = [by.get(k, rest) + MARGIN for k in model.langs]


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score, cross_entropy and rejected, from the text alone.

    A null text or one without a letter is ``und`` with score 0, null cross-entropy, rejected. Without a model (no training
    row) every text is. Equal cross-entropies give the language that is first by name; long texts are read in pieces without a
    change of result; an empty table gives an empty one. Repeated rows stay; columns with the names given here are replaced.
    """
    made = ("lang_pred", "score", "cross_entropy", "rejected")
    keep = [c for c in docs.columns if c.lower() not in made]
    if not model.langs:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    sums = free_name(docs, "_sums")
    seen = _with_sums(docs.select(*keep), model, text_col, sums).withColumn(sums + "e", _entropies(sums))
    n, entropy = F.col(f"{sums}.n"), F.col(sums + "e")
    low, none = F.array_min(entropy), n == 0
    best = F.array_position(entropy, low).cast("int")
    # the posterior of the best language, as if up to 32 characters were independent evidence
    odds = F.aggregate(entropy, F.lit(0.0), lambda a, e: a + F.exp((low - e) * F.least(n, F.lit(32))))
    limit = F.element_at(F.array(*map(F.lit, model.limits)), best) + 6.0 / F.sqrt(F.greatest(n, F.lit(1)))
    return seen.select(
        *keep,
        F.when(none, UNKNOWN).otherwise(F.element_at(F.array(*map(F.lit, model.langs)), best)).alias("lang_pred"),
        F.when(none, 0.0).otherwise(1.0 / odds).alias("score"),
        F.when(~none, low).alias("cross_entropy"),
        (none | (low > limit)).alias("rejected"),
    )


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the rows outside the held-out fold, predict every row; adds held_out."""
    fold = held_out(id_col)
    model = fit(docs.filter(~fold), text_col, lang_col)
    return predict(docs.drop("held_out").withColumn("held_out", fold), model, text_col)
