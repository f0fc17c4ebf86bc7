"""Language identification by Bayesian evidence fusion.

The text's likelihood under each language comes from hashed byte trigrams. The
declared markup language and the address suffix each have a likelihood table,
and the host has a prior that is smoothed by its domain's, which is smoothed by
the corpus's; tables and priors are sums of text posteriors by grouped
aggregation. The product of all, normalised, is the fused posterior. A row's own
posterior is taken out of its host's sums before they judge it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._neardup import STEP, mixed
from ._shared import col, cut, scan, table

#: Labelled rows that the trigram model is fitted on, about; every language has an equal share, of LEAST_ROWS at least.
TRAIN_ROWS, LEAST_ROWS, BUCKETS = 8000, 50, 1 << 15
#: A text's trigrams count as this many independent ones at most.
EFFECTIVE = 40.0
#: Rows that a parent's distribution weighs in its children's; pseudo-counts of the likelihood tables.
KAPPA, ALPHA = 8.0, 0.5

_DROP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-zA-Z]{2,3})\b", re.I)


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of a text in lower case, without digits and marks."""
    data = np.frombuffer((" " + text.lower() + " ").encode(), np.uint8).astype(np.uint64)
    data = np.where((data < 65) | ((data > 90) & (data < 97)) | ((data > 122) & (data < 128)), 32, data).astype(np.uint64)
    three = data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:]
    three = three[three != 0x202020]
    return (mixed(three * STEP) >> np.uint64(32)).astype(np.int64) % BUCKETS


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages in order, log probabilities by language and bucket).

    Fitted on a hash sample of about ``train_rows`` labelled rows, divided evenly
    among the languages (LEAST_ROWS for each at least, all rows of those that have
    fewer), so every label is in the model, a rare one too. Rows are drawn one by
    one, so copies of a text are not all in or all out. Tasks send counts by
    language and bucket; what comes to the driver is languages x BUCKETS numbers.
    Null labels are left out.
    """
    known = docs.select(col(text).alias("text"), col(lang).alias("lang"), F.xxhash64(*[col(c) for c in docs.columns]).alias("h")).where("lang is not null")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    languages = sorted(r["lang"] for r in sizes.select("lang").collect())
    share = max(LEAST_ROWS, train_rows // max(1, len(languages))) / F.col("n")
    sample = known.join(F.broadcast(sizes.select("lang", share.alias("share"))), "lang").where(F.pmod("h", F.lit(1 << 40)) < F.col("share") * (1 << 40)).select("text", "lang")  # a row a language
    place = {x: i for i, x in enumerate(languages)}

    def run(batches):
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if x in place:
                    counts[place[x]] += np.bincount(trigrams(t or ""), minlength=BUCKETS)
        which, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[which, bucket])], names=["which", "bucket", "n"])

    rows = sample.mapInArrow(run, "which int, bucket int, n long").groupBy("which", "bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.full((len(languages), BUCKETS), 0.1)
    for r in rows:
        counts[r["which"], r["bucket"]] += r["n"]
    return languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def likelihoods(rows: DataFrame, model: tuple[list[str], np.ndarray], text: str, keep: tuple[str, ...], markup: bool = False) -> DataFrame:
    """``keep``, ``declared`` (of markup only) and ``ll``, a log likelihood for each language."""
    languages, logs = model

    def make() -> Callable:
        def run(values: list[str | None]) -> list:
            declared, ll = [], []
            for value in values:
                value = value or ""
                if markup:
                    m = _LANG.search(value)
                    declared.append(m[1].lower() if m else None)
                    value = unescape(_DROP.sub(" ", value))
                else:
                    declared.append(None)
                at = trigrams(value)
                total = logs[:, at].astype(np.float64).sum(axis=1) if len(at) else np.zeros(len(languages))
                total *= min(1.0, EFFECTIVE / max(1, len(at)))
                ll.append((total - total.max(initial=-np.inf)).tolist() if len(languages) else [])
            return [declared, ll]

        return run

    return scan(rows, text, keep, [("declared", T.StringType()), ("ll", T.ArrayType(T.DoubleType()))], make)


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def _product(ll: list[Column]) -> list[Column]:
    """Posteriors from log likelihoods, one column a language."""
    top = reduce(F.greatest, ll) if len(ll) > 1 else ll[0]
    raw = [F.exp(x - top) for x in ll]
    whole = sum(raw[1:], raw[0])
    return [r / whole for r in raw]


def fuse(rows: DataFrame, languages: list[str], keep: tuple[str, ...]) -> DataFrame:
    """``keep``, ``lang``, ``confidence`` and ``text_lang`` from rows with ``ll``, ``declared``, ``host``.

    Without any language all are null. A missing host, suffix or declaration is
    no evidence. Equal posteriors go to the language that is first by name.
    """
    if not languages:
        return rows.select(*keep, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"))
    k = range(len(languages))
    text = _product([F.get("ll", F.lit(i)) for i in k])
    rows = rows.select(*keep, "ll", "declared", "host", *[p.alias(f"t{i}") for i, p in enumerate(text)])
    dotted = F.col("host").contains(".")
    rows = rows.withColumn("suffix", F.when(dotted, F.element_at(F.split("host", r"\."), -1)))
    rows = cut(rows.withColumn("domain", F.when(dotted, F.array_join(F.slice(F.split("host", r"\."), -2, 2), ".")).otherwise(F.col("host"))))
    sums = [F.sum(f"t{i}").alias(f"s{i}") for i in k]

    def counts(by: str, name: str) -> DataFrame:
        """Sums of text posteriors by a column, one row for each of its values."""
        return rows.where(F.col(by).isNotNull()).groupBy(F.col(by)).agg(*[F.sum(f"t{i}").alias(f"{name}{i}") for i in k])

    whole = rows.agg(*sums).first()
    total = [float(whole[f"s{i}"] or 0) for i in k]
    base = [(t + 1) / (sum(total) + len(total)) for t in total]
    # declarations and suffixes: how likely each is in a language
    declared, suffix = counts("declared", "d"), counts("suffix", "x")
    of_declared = rows.where("declared is not null").agg(*sums).first()
    of_suffix = rows.where("suffix is not null").agg(*sums).first()
    out = rows.join(counts("host", "h"), "host", "left").join(counts("domain", "o"), "domain", "left").join(declared, "declared", "left").join(suffix, "suffix", "left")

    def without(name: str, i: int) -> Column:
        return F.greatest(F.lit(0.0), F.coalesce(F.col(f"{name}{i}") - F.col(f"t{i}"), F.lit(0.0)))

    mass = lambda name: sum((without(name, i) for i in k[1:]), without(name, 0))
    scores = []
    for i in k:
        by_domain = (without("o", i) + KAPPA * base[i]) / (mass("o") + KAPPA)
        by_host = (without("h", i) + KAPPA * by_domain) / (mass("h") + KAPPA)
        score = F.get("ll", F.lit(i)) + F.log(by_host)
        for name, found in (("d", of_declared), ("x", of_suffix)):
            there = float(found[f"s{i}"] or 0)
            score = score + F.when(F.col(f"{name}0").isNotNull(), F.log((without(name, i) + ALPHA) / (F.lit(there) + 4 * ALPHA))).otherwise(0.0)
        scores.append(score)
    fused = _product(scores)
    out = out.select(*keep, *[f"t{i}" for i in k], *[p.alias(f"p{i}") for i, p in enumerate(fused)])

    def best(name: str) -> Column:
        top = F.greatest(*[F.col(f"{name}{i}") for i in k]) if len(languages) > 1 else F.col(f"{name}0")
        return F.coalesce(*[F.when(F.col(f"{name}{i}") == top, x) for i, x in enumerate(languages)])

    top = F.greatest(*[F.col(f"p{i}") for i in k]) if len(languages) > 1 else F.col("p0")
    return out.select(*keep, best("p").alias("lang"), F.round(top, 6).alias("confidence"), best("t").alias("text_lang"))


def identify(pages: DataFrame, docs: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """One row for each page and document: ``doc_id``, ``page_id``, ``lang``, ``confidence``, ``text_lang``.

    ``text_lang`` is what the text alone says. A document's source stands for
    its host; it has no markup and no suffix. Pages carry -1 - page_id as
    ``doc_id``, documents a null ``page_id``. Null and empty texts leave it to the
    other evidence. Repeated rows get equal values (their host's sums count them all).
    """
    model = fit(train if train is not None else docs)
    web = likelihoods(pages.select("page_id", host_of(F.col("url")).alias("host"), "html"), model, "html", ("page_id", "host"), markup=True)
    own = likelihoods(docs.select("doc_id", F.col("source").alias("host"), "text"), model, "text", ("doc_id", "host"))
    rows = web.select((-1 - F.col("page_id")).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), "host", "declared", "ll").unionByName(
        own.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), "host", "declared", "ll")
    )
    return fuse(rows, model[0], ("doc_id", "page_id"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page and every document."""
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


QUERIES = {"op9_language_id": op9_language_id}
SQL: dict[str, str] = {}
