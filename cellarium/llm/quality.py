"""Per-document text statistics and their robust distance from prose.

Every statistic is read from the whole text. For each language, mean and covariance of all
statistics are estimated from the documents that look like prose in it: a start within a few robust
deviations of the median, then two rounds in which the documents nearest to the estimate give the
next one. A document's distance is the Mahalanobis distance to its language's estimate; whether it is
junk is decided by the same distance of its deviation without those to a better side. The share of
every statistic in either distance is reported. The estimates are sums over all documents; only they
(languages times statistics squared numbers) reach the driver.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from cellarium.session import materialise

# Very common words of each language, not shared with the others.
COMMON = {
    "en": "the of and to in it is was that with for on as at by be this not had have but or an if from they which you we their its my so than more no has were are our she he would one all when who".split(),
    "de": "der die das und ist nicht ein eine zu mit auf aus dem den des im es ich wir war noch auch sich aber hat obwohl weil als wie von nach bei bleibt blieb wirkte schien man so zum am einem wer wenn hier sehr nur".split(),
    "fr": "le la les de des du et est un une pas plus qui que dans pour sur ce cette au aux en était mais nous on je il elle ne sans sont avec parce très restait trop bien avait se son ont après par".split(),
    "es": "el la los las de del y es un una no que en con por para se lo al su más muy pero como estaba este esta ya sin fue sido mucho todavía nos porque quien cuando hay después son ha si".split(),
}
_WORD, _SYMBOL = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?"), re.compile(r"[^\w\s.,;:!?'’\"()\-–—&]")
_ENTITY = re.compile(r"&(?:[a-z]+|#\d+);")
_SETS = {lang: frozenset(words) for lang, words in COMMON.items()}
_SPEAKERS = {w: [lang for lang, words in _SETS.items() if w in words] for w in frozenset().union(*_SETS.values())}

STATISTICS = ["mean_word_length", "symbol_ratio", "digit_ratio", "letter_ratio", "line_end_share", "words_per_line", "common_word_share", "prose_line_share", "log_new_triple_share", "new_line_share"]
#: Directions in which a statistic moves away from prose: -1 below, 1 above, 0 either way.
WORSE = {"mean_word_length": 0, "symbol_ratio": 1, "digit_ratio": 1, "letter_ratio": -1, "line_end_share": 0, "words_per_line": -1, "common_word_share": -1, "prose_line_share": -1, "log_new_triple_share": -1, "new_line_share": -1}
#: Statistics that follow how a text is wrapped: they are reported but set to the mean before junk is decided.
WRAPPING = {"line_end_share"}
#: Squared distance in those directions from which a document isn't prose: one whose words mostly
#: stand in lines of prose must lie further off than one whose words don't.
CUTOFF, CUTOFF_PROSE_LINES, PROSE_LINES = 4.6, 9.0, 0.6
#: Least standard deviation of a statistic, so that one that hardly varies can't decide alone.
FLOOR = {"mean_word_length": 0.5, "symbol_ratio": 0.02, "digit_ratio": 0.08, "letter_ratio": 0.06, "line_end_share": 0.3, "words_per_line": 1.2, "common_word_share": 0.045, "prose_line_share": 0.1, "log_new_triple_share": 0.55, "new_line_share": 0.15}


def statistics(text: str) -> tuple[str, int, list[float]]:
    """Language by common words ("und" if none occurs), number of words, and the statistics."""
    text = _ENTITY.sub(" ", text)
    lines = [x for x in (line.strip() for line in text.splitlines()) if x]
    by_line = [_WORD.findall(line.lower()) for line in lines]
    words = [w for line in by_line for w in line]
    n, chars, letters = len(words), len("".join(text.split())), sum(map(len, words))
    digits = sum(map(text.count, "0123456789")) if text.isascii() else sum(map(str.isdigit, text))
    spoken = dict.fromkeys(_SETS, 0)
    for w in words:
        for lang in _SPEAKERS.get(w, ()):
            spoken[lang] += 1
    lang = max(spoken, key=spoken.get)
    common, share = _SETS[lang], spoken[lang] / max(n, 1)
    # A line counts as prose if it has some words and about one in twelve is common; one that is part of a wrapped sentence may have none, so its neighbours vouch for it.
    hits, sizes = [sum(map(common.__contains__, line)) for line in by_line], [len(line) for line in by_line]
    prose = [size >= 3 and sum(hits[max(0, i - 1) : i + 2]) * 12 >= sum(sizes[max(0, i - 1) : i + 2]) and (hits[i] > 0 or size >= 4) for i, size in enumerate(sizes)]
    triples = max(n - 2, 0)
    values = [
        letters / max(n, 1),
        len(_SYMBOL.findall(text)) / max(chars, 1),
        digits / max(chars, 1),
        letters / max(chars, 1),
        sum(line[-1] in ".!?…\"”»)" for line in lines) / max(len(lines), 1),
        math.log1p(n / max(len(lines), 1)),
        share,
        sum(size for size, p in zip(sizes, prose) if p) / max(n, 1),
        math.log(len(set(zip(words, words[1:], words[2:]))) / triples) if triples else 0.0,
        len(set(lines)) / max(len(lines), 1),
    ]
    return (lang if share > 0.03 else "und"), n, values


_STATS = StructType([StructField("spoken", StringType()), StructField("word_count", LongType()), *[StructField(s, DoubleType()) for s in STATISTICS]])


@F.pandas_udf(_STATS)
def statistics_udf(texts: pd.Series) -> pd.DataFrame:
    rows = [(lang, n, *values) for lang, n, values in (statistics(t) for t in texts)]
    return pd.DataFrame(rows, columns=[f.name for f in _STATS.fields])


def document_statistics(documents: DataFrame) -> DataFrame:
    """``doc_id, spoken, word_count`` and the statistics of every document that isn't blank or null.

    ``spoken`` is read from the text; a text without common words falls under the stated language,
    if that is a known one, else under English.
    """
    filled = documents.where(F.col("text").rlike(r"\S")).select("doc_id", "lang", "text")
    read = filled.withColumn("s", statistics_udf("text")).select("doc_id", "lang", "s.*")
    stated = F.when(F.lower(F.trim("lang")).isin(*COMMON), F.lower(F.trim("lang")))
    return read.withColumn("spoken", F.when(F.col("spoken") == "und", F.coalesce(stated, F.lit("en"))).otherwise(F.col("spoken"))).drop("lang")


def _moments(stats: DataFrame) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    pairs = [(i, j) for i in range(len(STATISTICS)) for j in range(i, len(STATISTICS))]
    c = [F.col(s) for s in STATISTICS]
    rows = stats.groupBy("spoken").agg(F.count("*").alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(c)], *[F.avg(c[i] * c[j]).alias(f"p{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for r in rows:
        mean = np.array([r[f"m{i}"] for i in range(len(c))])
        cov = np.zeros((len(c), len(c)))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"p{i}_{j}"] - mean[i] * mean[j]
        out[r["spoken"]] = (float(r["n"]), mean, cov)
    return out


def _regular(cov: np.ndarray) -> np.ndarray:
    """Inverse covariance, with every statistic's deviation raised to its floor."""
    floor = np.array([FLOOR[s] ** 2 for s in STATISTICS])
    return np.linalg.inv(cov + np.diag(np.maximum(floor - np.diag(cov), floor * 0.25)))


def fit_prose(stats: DataFrame, rounds: int = 2) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean and inverse covariance of prose per language."""
    if stats.isEmpty():
        return {}
    mid = stats.groupBy("spoken").agg(*[F.percentile_approx(s, [0.25, 0.5, 0.75], 2000).alias(s) for s in STATISTICS])
    rows = {r["spoken"]: r for r in mid.collect()}
    near = F.lit(False)
    for lang, r in rows.items():
        inside = F.col("spoken") == lang
        for s in ("common_word_share", "prose_line_share", "log_new_triple_share", "digit_ratio", "symbol_ratio"):
            low, middle, high = r[s]
            reach = 3 * max((high - low) / 1.35, FLOOR[s])
            inside = inside & F.col(s).between(middle - reach, middle + reach)
        near = near | inside
    fit = {lang: (mean, _regular(cov)) for lang, (_, mean, cov) in _moments(stats.where(near)).items()}
    for _ in range(rounds):
        measured = with_distance(stats, fit).where(F.col("distance2") <= 2.5 * len(STATISTICS))
        again = {lang: (mean, _regular(cov)) for lang, (n, mean, cov) in _moments(measured).items() if n > len(STATISTICS)}
        fit |= again
    return fit


def with_distance(stats: DataFrame, fit: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Add ``distance2``, ``junk_distance2``, and one ``<statistic>_part`` and ``<statistic>_junk_part`` per statistic.

    The parts add up to their squared distance. ``junk_distance2`` is the squared distance after every
    statistic that deviates to its better side is set to the mean, as are those of ``WRAPPING``; the
    others, also those without a better side, count with all covariances.
    """
    fallback = next(iter(fit.values())) if fit else (np.zeros(len(STATISTICS)), np.eye(len(STATISTICS)))
    shape = StructType([StructField("distance2", DoubleType()), StructField("junk_distance2", DoubleType()), *[StructField(f"{s}_{p}", DoubleType()) for p in ("part", "junk_part") for s in STATISTICS]])
    side, wrapping = np.array([WORSE[s] for s in STATISTICS]), np.array([s in WRAPPING for s in STATISTICS])

    @F.pandas_udf(shape)
    def measure(spoken: pd.Series, *cols: pd.Series) -> pd.DataFrame:
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        parts, junk = np.zeros_like(x), np.zeros_like(x)
        for lang in spoken.unique():
            mean, inverse = fit.get(lang, fallback)
            at = (spoken == lang).to_numpy()
            d = x[at] - mean
            parts[at] = d * (d @ inverse)
            worse = np.where(~wrapping & ((side == 0) | (np.sign(d) == side)), d, 0)
            junk[at] = worse * (worse @ inverse)
        return pd.DataFrame(np.column_stack([parts.sum(axis=1), junk.sum(axis=1), parts, junk]), columns=[f.name for f in shape.fields])

    return stats.withColumn("d", measure("spoken", *STATISTICS)).select(*[f"`{c}`" for c in stats.columns], "d.*")


def quality_report(documents: DataFrame) -> DataFrame:
    """Statistics, distances, parts and ``is_junk`` of every document that isn't blank."""
    stats = materialise(document_statistics(documents))
    return with_distance(stats, fit_prose(stats)).withColumn("is_junk", F.col("junk_distance2") >= F.when(F.col("prose_line_share") > PROSE_LINES, CUTOFF_PROSE_LINES).otherwise(CUTOFF))
