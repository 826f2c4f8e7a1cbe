"""Token budgets: per-language regressions on counts of characters and words, corrected on tokenized holdouts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.kernels import code_points, tables
from corvane.llm.language import NAMES, NOT_KNOWN
from corvane.llm.tokens import RANKS, count_tokens
from corvane.session import table

#: Texts that are tokenized to fit the regressions (half) and to correct their bias (the other half), drawn by hash.
SAMPLE = 20_000
#: A language with fewer fitted texts than this takes the regression over all languages.
LEAST = 200
FEATURES = ("one", "bytes", "words", "digits", "punctuation", "capitals", "spaces", "accented", "other_script", "digit_runs", "long_words")


def features(texts: list[str | None]) -> np.ndarray:
    """(text, feature) counts of whole texts."""
    is_word, low = tables()
    cp, starts = code_points(texts)
    n = len(texts)
    if not n:
        return np.zeros((0, len(FEATURES)))
    digit = (cp >= 48) & (cp <= 57)
    word = is_word[cp]
    letter = word & ~digit
    space = (cp == 32) | (cp == 10) | (cp == 9) | (cp == 0xA0)
    begin, dbegin = word.copy(), digit.copy()
    begin[1:] &= ~word[:-1]
    dbegin[1:] &= ~digit[:-1]
    long_ = letter.copy()
    for k in range(1, 9):  # a word's ninth letter
        long_[k:] &= letter[:-k]
        long_[:k] = False
    long_[9:] &= ~(letter[:-9] & long_[8:-1]) if len(cp) > 9 else True
    width = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
    per = lambda x: np.add.reduceat(x.astype(np.int64), starts[:-1])
    out = [np.ones(n), per(width) - 1, per(begin), per(digit), per(~word & ~space), per(letter & (low[cp] != cp)), per(space) - 1, per((cp > 0x7F) & (cp < 0x250)), per(cp >= 0x250), per(dbegin), per(long_)]
    return np.stack(out, axis=1).astype(float)


def fit(x: np.ndarray, y: np.ndarray, lang: np.ndarray, half: np.ndarray) -> dict[str, tuple[np.ndarray, float]]:
    """Language to weights and bias factor; '' holds the regression over all."""

    def one(rows: np.ndarray) -> tuple[np.ndarray, float]:
        a, b = rows & half, rows & ~half
        scale = np.maximum(np.abs(x[a]).mean(axis=0), 1e-9)
        z = x[a] / scale
        w = np.linalg.solve(z.T @ z + 1e-3 * a.sum() * np.eye(z.shape[1]) * 1e-3, z.T @ y[a]) / scale
        got = np.maximum(x[b] @ w, 0).sum()
        return w, float(y[b].sum() / got) if got else 1.0

    out = {}
    every = np.ones(len(y), bool)
    if (every & half).any():
        out[""] = one(every)
    for k in sorted(set(lang.tolist())):
        if ((lang == k) & half).sum() >= LEAST:
            out[k] = one(lang == k)
    return out


def clean_language(c: F.Column) -> F.Column:
    """Two-letter code however the label is written; 'und' where it names none."""
    s = F.lower(F.trim(F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*([^-_]*)", 1)))
    known = F.create_map(*(F.lit(x) for kv in NAMES.items() for x in kv))
    return F.when(s.isin(*NOT_KNOWN), "und").otherwise(F.coalesce(F.try_element_at(known, s), s))


def clean_domain(c: F.Column) -> F.Column:
    """Lower case without outer spaces; 'unknown' where missing."""
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(s == "", "unknown").otherwise(s)


def estimate_tokens(texts: DataFrame, sample: int = SAMPLE, ranks: str = RANKS) -> DataFrame:
    """``texts(key, text, lang, ...)`` with ``est_tokens`` in place of ``text``.

    About ``sample`` texts, drawn by a hash of their keys, are tokenized. Ordinary least squares on
    half of them gives each language's weights; the other half gives the factor that makes its
    total right. Every text is then measured whole and estimated. A null or empty text has 0 tokens;
    a language with few texts takes the weights over all; repeated rows count each; an empty table
    gives an empty result; other columns are kept.
    """
    spark = texts.sparkSession
    n = texts.count()
    h = F.xxhash64(F.col("key"), F.lit(77))
    drawn = texts.filter(F.col("text").isNotNull() & (F.pmod(h, F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(n, 1)))))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column(0).to_pylist()
            x = features(t)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(count_tokens(t, ranks), pa.int64()), pa.array(list(x), pa.list_(pa.float64()))], ["lang", "half", "tokens", "x"])

    got = drawn.select("text", "lang", (F.pmod(F.shiftright(h, 24), F.lit(2)) == 0).alias("half")).mapInArrow(measure, "lang string, half boolean, tokens long, x array<double>").toPandas()  # ``sample`` rows
    model = fit(np.array(got["x"].tolist()).reshape(-1, len(FEATURES)), got["tokens"].to_numpy(float), got["lang"].to_numpy(str), got["half"].to_numpy(bool)) if len(got) else {}
    shared = spark.sparkContext.broadcast(model)  # a line a language
    keep = [c for c in texts.columns if c != "text"]
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            x = features(b.column("text").to_pylist())
            lang = np.array(b.column("lang").to_pylist(), str)
            est = np.zeros(len(x))
            for k in set(lang.tolist()):
                w = m.get(k) or m.get("")
                if w:
                    rows = lang == k
                    est[rows] = np.maximum(x[rows] @ w[0], 0) * w[1]
            est[x[:, 1] == 0] = 0
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(est)], [*keep, "est_tokens"])

    return texts.select("text", *keep).mapInArrow(apply, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", est_tokens double")


def _estimated(spark: SparkSession, d: str) -> DataFrame:
    tx, er = table(spark, d, "embedding_texts"), table(spark, d, "embedding_records")
    rows = tx.select(F.col("text_key").alias("key"), "record_id", "text", clean_language(F.col("lang")).alias("lang"), clean_domain(F.col("domain_name")).alias("domain_name"))
    source = er.groupBy("record_id").agg(F.max_by("source_name", "ingested_at").alias("source_name"))
    return estimate_tokens(rows).join(source, "record_id", "left")


def p6_token_budget(spark: SparkSession, d: str) -> DataFrame:
    """Texts and estimated tokens by source, language and domain."""
    per = _estimated(spark, d).groupBy(F.coalesce("source_name", F.lit("unknown")).alias("source_name"), "lang", "domain_name")
    return per.agg(F.count(F.lit(1)).alias("texts"), F.round(F.sum("est_tokens")).cast("long").alias("est_tokens"))


def p6_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Estimated beside counted tokens by language, every text tokenized."""
    from corvane.llm.tokens import with_tokens

    tx = table(spark, d, "embedding_texts").select(F.col("text_key").alias("key"), "text")
    true = with_tokens(tx, ["key"])
    per = _estimated(spark, d).join(true, "key").groupBy("lang")
    return per.agg(F.count(F.lit(1)).alias("texts"), F.sum("tokens").alias("tokens"), F.round(F.sum("est_tokens")).cast("long").alias("est_tokens"), F.round(F.sum(F.abs(F.col("est_tokens") - F.col("tokens"))) / F.sum("tokens"), 4).alias("mean_error_share"))
