"""Language identification by Bayesian evidence fusion.

A record is a text with what came along: a declared markup language, the suffix of its address, its
host and the domain above it; each may be missing.  For each language the posterior is the product of

* the likelihood of the text, from hashed byte trigrams (their logarithms are scaled down by TEMPER,
  because neighbouring trigrams overlap);
* the likelihoods of the declared language and of the address suffix, from grouped counts of both
  against the language that the text alone suggests;
* a prior of the host, smoothed towards its domain, which is smoothed towards all records.

All tables are grouped aggregates over all records; a record does not count towards its own host's
prior.  A uniform model stands for text of no known language.  A record is rejected when that model
wins or when no language reaches LEAST; a record without any text is rejected as well.

Every declared language has a model; the models are smoothed towards the text of all languages, which
matters for those with little text.  A declaration counts as DECLARED further records that say the
same, so it decides where records are few and fades with their number; no count switches a rule.
The evidence of a record is one array over the languages.  Nulls: missing evidence is left out.
Repeated rows and null ids are rows like others; extra columns are ignored; without any known language
there is no model to judge by, and all records with some text are kept with a null language.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm import arrays
from panelcast.llm.tables import share
from panelcast.sources.tables import materialise

SLOTS, TEMPER, LEAST, STRENGTH, DECLARED = 1 << 16, 0.2, 0.5, 5.0, 5.0
#: Trigrams of all languages' text that are added to each language.
SHARED = 1000.0
_FOLD = arrays.LOWER.copy()
_FOLD[48:58] = 48  # all digits are one: they tell nothing about a language
_EVIDENCE = ("doc_id", "kind", "asked", "declared", "suffix", "host", "domain")


def document_records(docs: DataFrame) -> DataFrame:
    """Documents: the lang column is what was declared, the source is the host."""
    none = F.lit(None).cast("string")
    return docs.select("doc_id", F.lit("document").alias("kind"), F.lit(True).alias("asked"), "text", F.lower("lang").alias("declared"), none.alias("suffix"), F.col("source").alias("host"), none.alias("domain"))


def page_records(pages: DataFrame, asked: bool = True) -> DataFrame:
    """Web pages: text without markup, language of the html tag, suffix, host and domain of the url."""
    html = F.coalesce("html", F.lit(""))
    tag = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-z]+)", 1))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&[a-z#0-9]+;", " ")
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1))
    pick = lambda x: F.when(x != "", x)
    return pages.select(
        F.col("page_id").alias("doc_id"), F.lit("page").alias("kind"), F.lit(asked).alias("asked"), text.alias("text"), pick(tag).alias("declared"),
        pick(F.regexp_extract(host, r"\.([a-z]+)$", 1)).alias("suffix"), pick(host).alias("host"),
        pick(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"),
    )


def _slots(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot of every byte trigram inside a row, and where each row's trigrams begin."""
    low = _FOLD[raw].astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    code = ((low[:-2] | (low[1:-1] << 8) | (low[2:] << 16)) * np.uint32(2654435761)) >> np.uint32(16)
    start, _ = arrays.starts_of(at, 3)
    return code[start].astype(np.int64), np.concatenate(([0], np.cumsum(np.maximum(np.diff(at) - 2, 0))))


def _trigram_counts(records: DataFrame, languages: list[str]) -> np.ndarray:
    """Counts of the slots in records declared in each language; the driver gets SLOTS rows a language at most."""
    number = {x: i for i, x in enumerate(languages)}

    def body(batches):
        total = np.zeros(SLOTS * len(languages), np.int64)
        for batch in batches:
            own = np.array([number.get(x, -1) for x in batch.column(0).to_pylist()])
            data, at = arrays.utf8(batch.column(1))
            for a, b in arrays.runs(at):
                slot, first = _slots(data[at[a] : at[b]], at[a : b + 1] - at[a])
                lang = np.repeat(own[a:b], np.diff(first))
                total += np.bincount((lang * SLOTS + slot)[lang >= 0], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["cell", "n"])

    rows = records.select("declared", "text").mapInArrow(body, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SLOTS * len(languages))
    out[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy()
    return out.reshape(len(languages), SLOTS)


def text_models(counts: np.ndarray) -> np.ndarray:
    """Logarithms of the slots' likelihoods in each language and, last, in the uniform model."""
    shared = SHARED * counts.sum(0) / max(counts.sum(), 1.0)
    own = counts + 0.5 + shared
    model = np.log(own / own.sum(1, keepdims=True))
    return np.concatenate((model, np.full((1, SLOTS), -np.log(SLOTS))))


def _text_scores(records: DataFrame, counts: np.ndarray) -> DataFrame:
    """Evidence columns, n_grams and the tempered log-likelihood of each language and of the uniform model."""
    table = share(records.sparkSession, text_models(counts))

    def body(batches):
        for batch in batches:
            data, at = arrays.utf8(batch.column(batch.num_columns - 1))
            for a, b in arrays.runs(at):
                slot, first = _slots(data[at[a] : at[b]], at[a : b + 1] - at[a])
                scores = []
                for row in table.value:
                    total = np.concatenate(([0.0], np.cumsum(row[slot])))
                    scores.append(TEMPER * (total[first[1:]] - total[first[:-1]]))
                x = np.stack(scores, axis=1)
                cuts = np.arange(b - a + 1, dtype=np.int32) * x.shape[1]
                yield pa.record_batch(
                    [*(batch.column(i).slice(a, b - a) for i in range(len(_EVIDENCE))), pa.array(np.diff(first)), pa.ListArray.from_arrays(cuts, pa.array(x.reshape(-1)))],
                    [*_EVIDENCE, "n_grams", "scores"],
                )

    schema = "doc_id long, kind string, asked boolean, declared string, suffix string, host string, domain string, n_grams long, scores array<double>"
    return records.select(*_EVIDENCE, "text").mapInArrow(body, schema)


def _counts(scored: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """For each value of *key*, how many records each of *n* languages has by text alone, as an array."""
    cells = scored.where(F.col(key).isNotNull()).groupBy(key, "text_lang").agg(F.count("*").cast("double").alias("c"))
    known = F.when(F.col("text_lang").isNotNull(), F.struct("text_lang", "c"))
    per = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(known)).alias("_m"))
    places = F.sequence(F.lit(0), F.lit(n - 1))
    return per.select(key, F.transform(places, lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0))).alias(name))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def _plus(*xs: Column) -> Column:
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), xs)


def identify(records: DataFrame) -> DataFrame:
    """doc_id, kind (document or page), lang, declared, posterior, text_lang and kept of every record that is asked for.

    Records that are not asked for take part in the counts only.
    """
    languages = sorted(r[0] for r in records.where("declared is not null").select("declared").distinct().collect())  # a row a language
    if not languages:
        none, some = F.lit(None).cast("string"), F.coalesce(F.octet_length("text"), F.lit(0)) > 2
        return records.where("asked").select("doc_id", "kind", none.alias("lang"), "declared", F.lit(0.0).alias("posterior"), none.alias("text_lang"), some.alias("kept"))
    n = len(languages)
    counts = _trigram_counts(records, languages)
    best = F.when(F.array_max("scores") > F.element_at("scores", n + 1), F.array_position("scores", F.array_max("scores")).cast("int") - 1)
    best = F.when(F.col("n_grams") > 0, best)
    base = materialise(_text_scores(records, counts).withColumn("text_lang", best))
    by = dict(base.where("text_lang is not null").groupBy("text_lang").count().collect())  # a row a language
    total = [float(by.get(i, 0)) for i in range(n)]
    array = lambda xs: F.array(*map(F.lit, xs))
    names, zeros, totals = array(languages), array([0.0] * n), array(total)

    met = base.where("asked")
    for key in ("declared", "suffix", "host", "domain"):
        met = met.join(_counts(base, key, n, f"n_{key}"), key, "left")
    places = F.sequence(F.lit(0), F.lit(n - 1))
    met = met.withColumn("own", F.transform(places, lambda i: F.coalesce((F.col("text_lang") == i).cast("double"), F.lit(0.0))))

    def smoothed(key: str, parent: str) -> Column:
        """Shares of the languages among the other records of this value, drawn towards *parent*."""
        others = F.zip_with(F.col(f"n_{key}"), F.col("own"), lambda c, o: F.greatest(c - o, F.lit(0.0)))
        all_ = _sum(others) + STRENGTH
        return F.when(F.col(f"n_{key}").isNotNull(), F.zip_with(others, F.col(parent), lambda c, p: (c + STRENGTH * p) / all_)).otherwise(F.col(parent))

    met = met.withColumn("prior", array([(x + 1) / (sum(total) + n) for x in total]))
    met = met.withColumn("prior", smoothed("domain", "prior")).withColumn("prior", smoothed("host", "prior"))
    said = F.transform(names, lambda x: F.coalesce((x == F.col("declared")).cast("double"), F.lit(0.0)))
    declared = F.zip_with(_plus(F.col("n_declared"), F.transform(said, lambda x: DECLARED * x)), totals, lambda c, t: F.log((c + 1.0) / (t + (n + 1.0 + DECLARED))))
    suffix = F.zip_with(F.col("n_suffix"), totals, lambda c, t: F.log((c + 1.0) / (t + (n + 1.0))))
    parts = (F.slice("scores", 1, n), F.transform("prior", lambda x: F.log(x)), F.coalesce(declared, zeros), F.coalesce(suffix, zeros))
    unknown = F.element_at("scores", n + 1) + F.lit(float(np.log(1.0 / (n + 1.0)))) * (
        1 + F.col("n_declared").isNotNull().cast("int") + F.col("n_suffix").isNotNull().cast("int")
    )
    met = met.select("doc_id", "kind", "declared", "n_grams", "text_lang", F.concat(_plus(*parts), F.array(unknown)).alias("logs"))
    met = met.withColumn("top", F.array_max("logs")).withColumn("at", F.array_position("logs", F.col("top")).cast("int"))
    weight = _sum(F.transform("logs", lambda x: F.exp(x - F.col("top"))))
    lang = F.when(F.col("at") <= n, F.element_at(names, F.least("at", F.lit(n))))
    kept = lang.isNotNull() & (1.0 / weight >= LEAST) & (F.col("n_grams") > 0)
    return met.select(
        "doc_id", "kind", lang.alias("lang"), "declared", (1.0 / weight).alias("posterior"),
        F.element_at(names, F.col("text_lang") + 1).alias("text_lang"), kept.alias("kept"),
    )
