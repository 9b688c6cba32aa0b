"""Toxicity: gradient-boosted trees over dense features of the text, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellspan.llm.common import materialize, pieces
from cellspan.llm.labelled import held_out, sample

#: Words of the second person in the four languages; characters that stand for letters.
SECOND = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen euch euer ihr tu te toi ton ta tes vous votre vos ti contigo tus usted ustedes vosotros os".split()
)
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"})
WORD = re.compile(r"[^\W\d_]+")
#: Runs of letters and of what stands in for them; what may go before such a word; single letters parted by marks or spaces.
STANDS_IN = "0134578@$!|€*"
RUN = re.compile(rf"(?:[^\W\d_]|[{re.escape(STANDS_IN)}])+")
BEFORE = frozenset(" \t\n\r\x0b\x0c.,;:!?\"'()")
PARTED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?!\w)")
STEMS = (4, 5, 6, 7, 8)
NAMES = ("hit_share", "hits", "kinds", "most_of_one", "weight_share", "near_you", "you_share", "capitals", "exclaims", "questions", "marks", "masked_hits", "masked_share", "log_words")


def word_forms(word: str) -> list[str]:
    """What a word may be listed under: itself, and its first letters where it is longer."""
    return ["=" + word, *(word[:n] for n in STEMS if len(word) >= n)]


def learn_lexicon(rows: DataFrame, size: int = 1000, least: int = 5, odds: float = 6.0) -> dict[str, float]:
    """rows(id, text, label) to {form: log odds}: the forms (words and stems) of at least `least` toxic documents that are
    `odds` times as frequent among the words of toxic documents as of other ones; the `size` found in most of them."""
    words = rows.select("id", "label", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), F.lit(1))).alias("w"))
    words = words.groupBy("id", "label", "w").agg(F.count("*").alias("n"))
    total = words.groupBy().pivot("label", [0, 1]).agg(F.sum("n")).na.fill(0).first()
    forms = F.array(F.concat(F.lit("="), "w"), *[F.when(F.length("w") >= n, F.substring("w", 1, n)) for n in STEMS])
    by_doc = words.select("id", "label", F.explode(forms).alias("form"), "n").where("form is not null").groupBy("id", "label", "form").agg(F.sum("n").alias("n"))
    bad, good = F.col("label") == 1, F.col("label") == 0
    counts = by_doc.groupBy("form").agg(F.sum(bad.cast("int")).alias("docs"), F.sum(F.when(bad, F.col("n"))).alias("bad"), F.coalesce(F.sum(F.when(good, F.col("n"))), F.lit(0)).alias("good"))
    ratio = ((F.col("bad") + 0.5) / (total["1"] + 1.0)) / ((F.col("good") + 2.0) / (total["0"] + 1.0))
    top = counts.where(F.col("docs") >= least).withColumn("ratio", ratio).where(F.col("ratio") >= odds).orderBy(F.desc("docs"), "form").limit(size)
    return {r["form"]: float(np.log(r["ratio"])) for r in top.collect()}


def masked_words(low: str) -> list[str]:
    """Words with a stand-in, a star or a digit before one of their letters; time is linear in the text."""
    out = []
    for m in RUN.finditer(low):
        x, before = m[0], low[m.start() - 1] if m.start() else " "
        if before not in BEFORE and not before.isspace():
            x = x.partition("!")[2]  # the word may begin after such a mark only
        x = x.rstrip(STANDS_IN)
        if not x.isalpha() and x:
            out.append(x)
    return out


@dataclass
class Featurizer:
    lexicon: dict[str, float]

    def __post_init__(self) -> None:
        self.cache: dict[str, float] = {}
        self.by_length: dict[int, list[str]] = {}
        for f in self.lexicon:
            if f[0] == "=":
                self.by_length.setdefault(len(f) - 1, []).append(f[1:])

    def weight(self, word: str) -> float:
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) > 1_000_000:  # a bound on memory
                self.cache.clear()
            got = self.cache[word] = max((self.lexicon.get(f, 0.0) for f in word_forms(word)), default=0.0)
        return got

    def unmasked(self, word: str) -> float:
        plain = word.translate(LEET)
        if "*" not in plain:
            return self.weight(plain)
        shape = re.compile(plain.replace("*", "."))
        return max((self.lexicon["=" + w] for w in self.by_length.get(len(plain), ()) if shape.fullmatch(w)), default=0.0)

    def __call__(self, text: str | None) -> list[float]:
        text = text or ""
        low = text.lower()
        words = WORD.findall(low)
        n = max(1, len(words))
        get = self.cache.get
        weights = [get(w) for w in words]
        for i, x in enumerate(weights):
            if x is None:
                weights[i] = self.weight(words[i])
        w = np.array(weights)
        hits = np.flatnonzero(w)
        you = np.array([i for i, x in enumerate(words) if x in SECOND], np.int64)
        near = 0
        if len(hits) and len(you):
            at = np.searchsorted(you, hits)
            after = np.abs(you[np.minimum(at, len(you) - 1)] - hits)
            before = np.abs(you[np.maximum(at - 1, 0)] - hits)
            near = int((np.minimum(after, before) <= 5).sum())
        masked = masked_words(low) if any(c in low for c in STANDS_IN) else []
        parted = [re.sub(r"[ .\-_*]", "", x) for x in PARTED.findall(low)]
        masked_hits = sum(self.unmasked(x) > 0 for x in masked) + sum(self.weight(x) > 0 for x in parted)
        chars = max(1, len(text))
        upper = sum(map(str.isupper, text)) if not text.islower() else 0
        return [
            len(hits) / n, np.log1p(len(hits)), np.log1p(len({words[i] for i in hits})),
            np.log1p(max(Counter(words[i][:5] for i in hits).values(), default=0)), float(w.sum()) / n, near / max(1, len(hits)), len(you) / n,
            upper / chars, text.count("!") / chars, text.count("?") / chars, sum(map(text.count, "#*$%&|<>.,;:")) / chars,
            np.log1p(masked_hits), (len(masked) + len(parted)) / n, np.log1p(len(words)),
        ]


def features(docs: DataFrame, lexicon: dict[str, float], names: list[str], text_col: str = "text") -> DataFrame:
    """The named columns of docs and the dense features, in order of NAMES."""
    schema = T.StructType([*(docs.schema[c] for c in names), *(T.StructField(c, T.DoubleType()) for c in NAMES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Featurizer(lexicon)
        for b in pieces(batches):
            x = np.array([of(t.as_py()) for t in b.column(len(names))], float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *(pa.array(c) for c in x.T)], names=schema.names)

    return docs.select(*names, text_col).mapInArrow(run, schema)


class ToxicityModel:
    def __init__(self, lexicon: dict[str, float], trees, steps, base: float):
        self.lexicon, self.trees, self.steps, self.base = lexicon, trees, steps, base

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id_col, score) for every row of docs; null and empty texts are scored like any other."""
        rows = features(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")), self.lexicon, ["__id"], "__t")
        if self.trees is None:
            return rows.select(F.col("__id").alias(id_col), F.lit(self.base).alias("score"))
        score = F.least(F.greatest(F.coalesce("calibrated", F.lit(self.base)), F.lit(0.0)), F.lit(1.0))
        return self.steps.transform(margins(self.trees, rows)).select(F.col("__id").alias(id_col), score.alias("score"))


def margins(trees, rows: DataFrame) -> DataFrame:
    x = VectorAssembler(inputCols=list(NAMES), outputCol="x").transform(rows)
    return trees.transform(x).withColumn("margin", vector_to_array("rawPrediction")[1])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000, modulus: int = 4, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Learns the lexicon and the trees on at most max_rows labelled documents; labels.toxic of ids with crc32 mod modulus
    equal to remainder are not looked at. Three quarters of the sample make lexicon and trees, the rest the calibration.
    Without labels of both kinds the score is their share of ones, 0 without any."""
    # a bounded sample in few partitions: trees and calibration run dozens of jobs over it
    rows = materialize(sample(docs, labels, "toxic", modulus, remainder, max_rows, id_col, text_col).repartition(8))
    ones, n = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    base = ones / n if n else 0.0
    fold = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(4)) == 0
    learn = rows.where(~fold)
    if learn.select("label").distinct().count() < 2:
        return ToxicityModel({}, None, None, base)
    lexicon = learn_lexicon(learn)
    dense = materialize(features(rows, lexicon, ["id", "label"]))
    x = VectorAssembler(inputCols=list(NAMES), outputCol="x").transform(dense.where(~fold))
    trees = GBTClassifier(featuresCol="x", labelCol="label", maxIter=12, maxDepth=3, stepSize=0.3, seed=7, maxBins=32).fit(x)
    rest = dense.where(fold) if dense.where(fold).select("label").distinct().count() == 2 else dense
    steps = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="calibrated").fit(margins(trees, rest).drop("x", "rawPrediction", "probability", "prediction"))
    return ToxicityModel(lexicon, trees, steps, base)


def score(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of docs."""
    out = fit(docs, labels, modulus=modulus, remainder=remainder, id_col=id_col, text_col=text_col).score(docs, id_col, text_col)
    return out.select(id_col, held_out(id_col, modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
