"""Language identification by Bayesian evidence fusion.

Text likelihoods come from hashed byte trigrams, trained on a bounded sample of labelled rows.
They are fused with the declared language, the address suffix and a host prior. All three are
learnt by grouped aggregation of the rows' text posteriors: a confusion table for the declared
language and for the suffix, and counts by host that are smoothed towards their parent domain,
this towards the suffix, this towards the whole corpus. A row's own share is taken out of its
host's counts. Rows with no letters, or whose text fits no language, are `und`.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, claim, scope, written

SAMPLE_PER_LANGUAGE = 400
#: The training sample stays so large however many labels there are; each has LEAST_TEXTS at least.
SAMPLE, LEAST_TEXTS = 25_600, 20
BUCKETS = 1 << 16
#: Weight of a trigram: neighbours overlap, so their likelihoods aren't independent.
TEMPER = 0.3
#: Pseudo-counts: of a parent's distribution in a child's, and of an unseen declaration or suffix.
PRIOR_ROWS, UNSEEN = 10.0, 1.0
#: A row is `und` below this posterior, or when it has LEAST_TRIGRAMS or more and their mean score has
#: gone so much of the way from a usual training text's to that of random trigrams.
LEAST_POSTERIOR, LEAST_TRIGRAMS, WAY = 0.5, 40, 0.7
RANDOM = -float(np.log(BUCKETS))
#: A training text with fewer trigrams is neither left out nor counted for the usual score.
LEAST_SCORED = 20
WORDS = re.compile(r"[^\W\d_]+")
SLICE_CHARS = 1 << 20


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all texts' byte trigrams over letters, and each text's number of them."""
    clean = [(" " + " ".join(WORDS.findall(t.lower())) + " ").encode() if t else b"" for t in texts]
    size = np.fromiter(map(len, clean), np.int64, len(clean))
    raw = np.frombuffer(b"".join(clean) + b"\0\0", np.uint8).astype(np.uint32)
    code = (raw[:-2] * np.uint32(40503) + raw[1:-1] * np.uint32(30011) * np.uint32(7) + raw[2:] * np.uint32(2654435761)) >> np.uint32(3)
    code &= np.uint32(BUCKETS - 1)
    ends = np.cumsum(size)
    count = np.maximum(size - 2, 0)
    keep = np.ones(len(code), bool)
    for back in (1, 2):
        at = ends - back
        keep[at[(size >= back)]] = False
    return code[keep], count


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # buckets x languages: log probabilities
    usual: float  # median of the training texts' mean scores

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of each text in each language, and its number of trigrams."""
        out, counts = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):
            stop, chars = at, 0
            while stop < len(texts) and (stop == at or chars + len(texts[stop] or "") <= SLICE_CHARS):
                chars += len(texts[stop] or "")
                stop += 1
            code, count = trigrams([t or "" for t in texts[at:stop]])
            counts[at:stop] = count
            live = np.nonzero(count)[0]
            if len(live):
                start = (np.cumsum(count) - count)[live]
                for j in range(len(self.languages)):
                    out[at + live, j] = np.add.reduceat(self.weights[:, j][code].astype(np.float64), start)
            at = stop
        return out, counts

    @classmethod
    def of(cls, languages: list[str], counts: np.ndarray, usual: float = 0.0) -> LanguageModel:
        """From trigram counts, languages x buckets."""
        smooth = counts.T + 0.05
        return cls(languages, np.log(smooth / smooth.sum(0)).astype(np.float32), usual)

    def keeps(self, score: np.ndarray, n: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Texts too short to tell, and those that the model puts in the language they're labelled with."""
        return (n < LEAST_SCORED) | (score.argmax(1) == own)


def _sample(labelled: DataFrame, text_col: str, label_col: str, per_language: int) -> tuple[DataFrame, list[str]]:
    """(lang, text) of up to per_language texts of each label, fewer where there are many, and the labels."""
    rows = labelled.where(F.col(label_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("lang"))
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}  # one row a label
    per_language = min(per_language, max(LEAST_TEXTS, SAMPLE // max(1, len(found))))
    # by hash, so the same texts for the same table: twice as many as asked for are looked at, in one pass
    parts = 1 << 30
    mine = F.pmod(F.xxhash64("text"), F.lit(parts))
    bounds = [F.lit(x) for lang, n in found.items() for x in (lang, int(min(1.0, 2 * per_language / n) * parts))]
    picked = rows.where(mine < F.create_map(*bounds)[F.col("lang")] if found else F.lit(False))
    order = Window.partitionBy("lang").orderBy("x", "text")
    ranked = picked.dropDuplicates(["lang", "text"]).withColumn("x", mine).withColumn("r", F.row_number().over(order))
    return written(ranked.where(F.col("r") <= per_language).select("lang", "text"), "language-sample"), sorted(found)


def _trigram_counts(sample: DataFrame, languages: list[str], first: LanguageModel | None = None) -> np.ndarray:
    """languages x buckets: trigrams of the texts that the first model keeps. Texts stay on the executors."""
    place = {lang: i for i, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("languages")
        for batch in batches:
            texts, own = batch.column(1).to_pylist(), np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            keep = first.keeps(*first.score(texts), own) if first else np.ones(len(texts), bool)
            for j in np.unique(own[keep]).tolist():
                code, _ = trigrams([t for t, k, x in zip(texts, keep, own) if k and x == j])
                bucket, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), j, np.int32)), pa.array(bucket.astype(np.int32)), pa.array(n.astype(np.int64))], names=["j", "bucket", "n"])

    rows = bounded_batches(sample).mapInArrow(run, "j int, bucket int, n bigint").groupBy("j", "bucket").agg(F.sum("n").alias("n")).toPandas()  # the model's size at most
    out = np.zeros((len(languages), BUCKETS))
    out[rows["j"].to_numpy(np.int64), rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return out


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel | None:
    """Trained on up to per_language rows of each label, fewer where there are many labels.

    Texts that a first model clearly puts elsewhere are left out of the second. Trigrams are counted
    where the texts are; only counts and scores come to the driver. Null labels, null and empty
    texts are left out, equal texts of a label count once. None without any labelled text.
    """
    with scope():
        sample, languages = _sample(labelled, text_col, label_col, per_language)
        if not languages:
            return None
        first = LanguageModel.of(languages, _trigram_counts(sample, languages))
        model = LanguageModel.of(languages, _trigram_counts(sample, languages, first))
        place = {lang: i for i, lang in enumerate(languages)}

        def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim("languages")
            for batch in batches:
                texts, own = batch.column(1).to_pylist(), np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
                keep = first.keeps(*first.score(texts), own)
                score, n = model.score(texts)
                yield pa.RecordBatch.from_arrays([pa.array((score.max(1) / np.maximum(n, 1))[keep & (n >= LEAST_SCORED)])], names=["mean"])

        scores = bounded_batches(sample).mapInArrow(means, "mean double").toPandas()["mean"]  # a number for each text of the sample
        model.usual = float(np.median(scores)) if len(scores) else RANDOM
        return model


def identify(
    docs: DataFrame, model: LanguageModel | None, id_cols: list[str], text: Column, declared: Column | None = None, host: Column | None = None, suffix: Column | None = None, prefix: str = "", references: bool = False
) -> DataFrame:
    """id_cols, lang, posterior, text_lang, n_trigrams, accepted for each row.

    declared, host and suffix may be null or left out; then they're no evidence. A null or empty
    text has no trigrams and is `und` and not accepted; so is every row when there is no model.
    prefix stands before the names of the five result columns, for id_cols that clash with them.
    references: the text holds HTML's character references, which are decoded first.
    Repeated rows are judged alike. Rows are neither dropped nor joined by id, so null ids are fine.
    """
    languages = model.languages if model else []
    lower = lambda c: F.coalesce(F.lower(c), F.lit("")) if c is not None else F.lit("")
    base = bounded_batches(docs).select(
        F.struct(*id_cols).alias("key"),
        text.alias("text"),
        lower(None if declared is None else F.regexp_extract(declared, r"^\s*([A-Za-z]{2,3})\b", 1)).alias("declared"),
        lower(host).alias("host"),
        lower(suffix).alias("suffix"),
    )
    if model is None:
        blank = {"lang": F.lit("und"), "posterior": F.lit(0.0), "text_lang": F.lit("und"), "n_trigrams": F.lit(0).cast("long"), "accepted": F.lit(False)}
        return base.select("key.*", *[c.alias(prefix + name) for name, c in blank.items()])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("languages")
        m = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            score, n = m.score([t and html.unescape(t) for t in texts] if references else texts)
            mean = score.max(1) / np.maximum(n, 1)
            odd = (n == 0) | (n >= LEAST_TRIGRAMS) & (mean < m.usual + WAY * (RANDOM - m.usual))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(batch.column(i) for i in (2, 3, 4)), pa.array(list(score * TEMPER), pa.list_(pa.float64())), pa.array(n, pa.int64()), pa.array(odd)],
                names=["key", "declared", "host", "suffix", "ll", "n", "odd"],
            )

    key = base.schema["key"].dataType.simpleString()
    share = lambda x: (lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))(F.transform(x, lambda v: F.exp(v - F.array_max(x))))
    k = range(len(languages))
    levels = ("declared", "suffix", "domain", "host")
    vector = F.array(*[f"n{i}" for i in k])
    with scope() as held:
        scored = written(base.mapInArrow(run, f"key {key}, declared string, host string, suffix string, ll array<double>, n bigint, odd boolean"), "langid")
        domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
        soft = scored.withColumn("p", share(F.col("ll"))).withColumn("domain", F.when(domain != "", domain).otherwise(F.col("host")))
        # one row for each set of evidence that occurs; the levels' counts are sums of these, and rows meet them in one join
        sets = written(soft.groupBy(*levels).agg(*[F.sum(F.when(~F.col("odd"), F.col("p")[i]).otherwise(0.0)).alias(f"n{i}") for i in k]), "evidence-sets")
        counts = sets.agg(*[F.sum(f"n{i}") for i in k]).first()  # one number for each language
        evidence = sets.select(*levels)
        for by in levels:
            sums = sets.where(F.col(by) != "").groupBy(by).agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in k])
            evidence = evidence.join(sums.select(by, vector.alias(f"{by}_n")), by, "left")
        evidence = written(evidence, "evidence")
        held.keep(scored, evidence)

    def toward(n: Column, parent: Column) -> Column:
        """Counts smoothed towards the parent's distribution."""
        total = F.aggregate(n, F.lit(0.0), lambda a, b: a + b)
        return F.transform(F.arrays_zip(n.alias("n"), parent.alias("q")), lambda z: (z["n"] + PRIOR_ROWS * z["q"]) / (total + PRIOR_ROWS))

    everything = F.array(*[F.lit(float(v or 0)) for v in counts])
    flat = F.array(*[F.lit(1.0 / len(languages))] * len(languages))
    # declared and suffix: P(value | language), from the same counts
    joined = soft.join(evidence, list(levels))
    zero = F.array(*[F.lit(0.0)] * len(languages))
    n = lambda by: F.coalesce(F.col(f"{by}_n"), zero)
    mine = F.when(F.col("odd"), zero).otherwise(F.col("p"))
    less = lambda a, b: F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: F.greatest(z["a"] - z["b"], F.lit(0.0)))
    prior = toward(everything, flat)
    prior = F.when(F.col("suffix_n").isNull(), prior).otherwise(toward(less(n("suffix"), mine), prior))
    prior = F.when(F.col("domain_n").isNull(), prior).otherwise(toward(less(n("domain"), mine), prior))
    with_domain = joined.withColumn("parent", prior)
    prior = F.when(F.col("host_n").isNull(), F.col("parent")).otherwise(toward(less(n("host"), mine), F.col("parent")))
    told = F.transform(F.arrays_zip(less(n("declared"), mine).alias("a"), everything.alias("b")), lambda z: F.log((z["a"] + UNSEEN) / (z["b"] + UNSEEN * 10)))
    told = F.when(F.col("declared_n").isNull(), zero).otherwise(told)
    fused = with_domain.withColumn("prior", prior).withColumn(
        "fused", F.transform(F.arrays_zip(F.col("ll"), F.col("prior"), told.alias("told")), lambda z: z["ll"] + F.log(F.greatest(z["prior"], F.lit(1e-6))) + z["told"])
    )
    names = F.array(*map(F.lit, languages))
    top = lambda x: F.get(names, (F.array_position(x, F.array_max(x)) - 1).cast("int"))
    settled = fused.withColumn("posterior", F.array_max(share(F.col("fused"))))
    accepted = ~F.col("odd") & (F.col("posterior") >= LEAST_POSTERIOR)
    return settled.select(
        "key.*",
        F.when(accepted, top(F.col("fused"))).otherwise("und").alias(f"{prefix}lang"),
        F.col("posterior").alias(f"{prefix}posterior"),
        F.when(F.col("odd"), "und").otherwise(top(F.col("ll"))).alias(f"{prefix}text_lang"),
        F.col("n").alias(f"{prefix}n_trigrams"),
        accepted.alias(f"{prefix}accepted"),
    )
