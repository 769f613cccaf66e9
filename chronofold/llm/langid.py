"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_batches, tidy

UNKNOWN = "und"
_MUL = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters (surrogates are none)."""
    return np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def grams(text: str | None, buckets: int, longest: int) -> np.ndarray:
    """Bucket of every character n-gram (n from 1 to longest) of the whole text.

    The text is lower-cased; runs of anything but letters are one blank, and words are set off by
    blanks on both sides. A text without a letter has no n-grams.
    """
    if not text:
        return np.zeros(0, dtype=np.int64)
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[code]
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    code = np.where(letter, code, np.uint32(0x20))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    code = np.concatenate([[0x20], code[keep], [0x20]]).astype(np.uint32)
    if not letter[-1]:
        code = code[:-1]
    out = []
    for n in range(1, min(longest, len(code)) + 1):
        h = np.full(len(code) - n + 1, n, dtype=np.uint32)
        for k in range(n):
            h = (h ^ code[k : len(code) - n + 1 + k]) * _MUL[k]
            h ^= h >> np.uint32(15)
        out.append(h & np.uint32(buckets - 1))
    return np.concatenate(out).astype(np.int64)


class LanguageModel:
    """langs, priors and the matrix of log-probabilities (buckets x languages)."""

    def __init__(self, langs: list[str], prior: np.ndarray, logp: np.ndarray, longest: int):
        self.langs, self.prior, self.logp, self.longest = langs, prior, logp, longest

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior of each text. Ties go to the language that sorts first."""
        names, scores = [], np.zeros(len(texts))
        for k, text in enumerate(texts):
            found = grams(text, len(self.logp), self.longest)
            if not len(found) or not self.langs:
                names.append(UNKNOWN)
                continue
            if len(found) > 4096:
                counts = np.bincount(found, minlength=len(self.logp))
                seen = np.flatnonzero(counts)
                total = self.prior + counts[seen] @ self.logp[seen]
            else:
                total = self.prior + self.logp[found].sum(axis=0)
            best = int(np.argmax(total))
            names.append(self.langs[best])
            scores[k] = 1.0 / np.exp(total - total[best]).sum()
        return names, scores


def fit(docs: DataFrame, where: Column, text_col: str = "text", lang_col: str = "lang", buckets: int = 1 << 14, longest: int = 3, smooth: float = 0.5, most_langs: int = 1000) -> LanguageModel:
    """Count n-grams of all rows that satisfy `where` and have a text and a language.

    Each task sums its own rows by language and bucket, so the shuffle holds at most
    languages x buckets rows per task, and the driver gets that table once (most_langs bounds it;
    more languages than that are an error, not a cut).
    """
    text_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
                found = grams(text, buckets, longest)
                if len(found):
                    if lang not in sums:
                        if len(sums) >= most_langs:
                            raise ValueError(f"more than {most_langs} languages")
                        sums[lang], rows[lang] = np.zeros(buckets, dtype=np.int64), 0
                    sums[lang] += np.bincount(found, minlength=buckets)
                    rows[lang] += 1
        for lang, total in sums.items():
            seen = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": np.append(seen, -1).astype(np.int32), "count": np.append(total[seen], rows[lang])})

    rows = docs.where(where & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.mapInPandas(tidy(count), "lang string, bucket int, count long").groupBy("lang", "bucket").agg(F.sum("count").alias("count")).toPandas()
    langs = sorted(counts["lang"].unique())
    if len(langs) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    matrix, docs_of = np.full((buckets, len(langs)), smooth), np.zeros(len(langs))
    for k, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        docs_of[k] = own.loc[own["bucket"] < 0, "count"].sum()
        own = own[own["bucket"] >= 0]
        matrix[own["bucket"], k] += own["count"]
    logp = np.log(matrix / matrix.sum(axis=0)) if langs else matrix
    return LanguageModel(langs, np.log(docs_of / docs_of.sum()) if langs else docs_of, logp, longest)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1).

    A null text or one without a letter is `und` with score 0, and so is every text if nothing was
    learned. Existing columns of these names are replaced; other columns stay.
    """
    text_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def score(texts: pd.Series) -> pd.DataFrame:
        names, scores = known.value.score(list(texts))
        return pd.DataFrame({"lang_pred": names, "score": scores})

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    both = docs.select(*kept, score(F.col(text_col).cast("string")).alias("__langid"))
    return both.select(*kept, F.col("__langid.lang_pred").alias("lang_pred"), F.col("__langid.score").alias("score"))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that a model must not learn from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True))
