"""Mixing to target weights with soft domain membership.

A classifier fitted on the labelled table gives every document a posterior over
domains. Nonnegative document rates are then fitted by projected gradient least
squares, so that the expected tokens of each domain (rate x tokens x posterior,
summed) meet their targets while rates stay near 1. All of it is DataFrame
expressions: each step is one aggregation over the documents, and what comes to
the driver is a few numbers for each domain.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import col, cut, fresh, table
from .line_dedup import handle

#: Labelled rows that the classifier is fitted on at most, those with the smallest hashes.
TRAIN_ROWS = 20_000
#: Features of the classifier; each stands in LEAST_ROWS training rows and tells LEAST_GAIN nats of a domain's rows at least.
FEATURES, LEAST_ROWS, LEAST_GAIN = 2048, 5, 6.0
#: Share of the corpus's tokens that each domain is to have, in the order of the domains.
TARGETS = {"clean": 0.96, "low": 0.02, "toxic": 0.02}
STEPS, TOLERANCE = 40, 1e-7
SEED = 20240501


def domain(quality: Column, toxic: Column) -> Column:
    """The domain of a labelled row; null where a label is missing."""
    return F.when(toxic == 1, "toxic").when((toxic == 0) & (quality == 1), "clean").when((toxic == 0) & (quality == 0), "low")


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def words_in(text: Column) -> Column:
    """The distinct words of a text in lower case, as runs of letters."""
    return F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"))


def style(text: Column, words: Column) -> Column:
    """What a text looks like, in steps, as an array of distinct strings; no word begins with #."""
    text = F.coalesce(text, F.lit(""))
    size = F.length(text) + 1
    step = lambda name, n: F.concat(F.lit(f"#{name}"), F.floor(F.log2(1 + 200 * n / size)).cast("string"))
    # few expressions: each takes half as long as taking the text apart into words
    marks, digits = (F.regexp_count(text, F.lit(f"[{chars}]")) for chars in ("#*$%&<>|!?", "0-9"))
    return F.array(step("marks", marks), step("digits", digits), step("distinct", 10 * F.size(words)), F.concat(F.lit("#length"), F.floor(F.log2(size)).cast("string")))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", names: tuple[str, ...] = tuple(TARGETS), train_rows: int = TRAIN_ROWS) -> tuple[list[str], dict[str, list[float]], list[float]]:
    """(domains, weights by feature, constants): a Bernoulli naive Bayes model.

    Fitted on at most ``train_rows`` labelled documents, so the ids that are
    broadcast, the features and the model are bounded whatever the corpus. Ids
    with more than one label count once for each. Without usable labels every
    posterior is even.
    """
    known = labels.select(col(id_col).alias("id"), domain(col("quality"), col("toxic")).alias("domain")).where(F.col("domain").isin(*names) & F.col("id").isNotNull())
    sample = known.distinct().orderBy(F.xxhash64("id"), "id", "domain").limit(train_rows)
    # the text is taken apart behind the join, where only the sample is left
    shown = docs.select(col(id_col).alias("id"), col(text).alias("text")).join(F.broadcast(sample), "id").select("domain", "text", words_in(F.col("text")).alias("words"))
    shown = cut(shown.select("domain", F.concat("words", style(F.col("text"), F.col("words"))).alias("traits")))
    sizes = {r["domain"]: r["n"] for r in shown.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    n = [sizes.get(d, 0) for d in names]
    whole = sum(n)
    counts = shown.select("domain", F.explode("traits").alias("trait")).where("trait <> ''").groupBy("trait").agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(f"n{i}") for i, d in enumerate(names)])
    share = [(F.col(f"n{i}") + 0.5) / (n[i] + 1.0) for i in range(len(names))]
    rows = sum((F.col(f"n{i}") for i in range(len(names))), F.lit(0))
    # what a feature tells: the largest pull of its domains' shares on the whole's
    overall = (rows + 0.5) / (whole + 1.0)
    told = reduce(F.greatest, [F.lit(float(n[i])) * F.abs(s * F.log(s / overall) + (1 - s) * F.log((1 - s) / (1 - overall))) for i, s in enumerate(share)])
    best = counts.where((rows >= LEAST_ROWS) & (overall < 1) & (told >= LEAST_GAIN)).orderBy(told.desc(), "trait").limit(FEATURES)
    model, constants = {}, []
    for r in best.collect():  # FEATURES rows at most
        model[r["trait"]] = [r[f"n{i}"] for i in range(len(names))]
    p = {t: [(c[i] + 0.5) / (n[i] + 1.0) for i in range(len(names))] for t, c in model.items()}
    for i in range(len(names)):
        constants.append(log((n[i] + 1) / (whole + len(names))) + sum(log(1 - q[i]) for q in p.values()))
    return list(names), {t: [log(q[i] / (1 - q[i])) for i in range(len(names))] for t, q in p.items()}, constants


def posteriors(docs: DataFrame, model: tuple, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, own, n, p0, p1, ...): tokens and domain posteriors of every row.

    Traits meet the model, FEATURES rows at most, by 64-bit hashes; their weights
    are whole billionths, so sums do not depend on their order. Rows with equal ids
    and texts are summed together, pre-aggregated in each task, and told apart
    again by their number, so a lost task changes nothing.
    """
    names, weights, constants = model
    k = range(len(names))
    rows = docs.select(col(id_col).alias("id"), handle(id_col, text).alias("own"), tokens(col(text)).alias("n"), col(text).alias("text"), words_in(col(text)).alias("words"))
    every = [("#", *[0] * len(names), 1)]  # a trait of every row
    table_ = docs.sparkSession.createDataFrame(every + [(t, *[round(x * 1e9) for x in w], 0) for t, w in weights.items()], "trait string, " + ", ".join(f"w{i} long" for i in k) + ", m int")
    table_ = table_.withColumn("h", F.xxhash64("trait")).drop("trait")
    shown = F.concat("words", style(F.col("text"), F.col("words")), F.array(F.lit("#"))).alias("shown")
    met = rows.select("id", "own", "n", shown).select("id", "own", "n", F.explode_outer("shown").alias("trait")).select("id", "own", "n", F.xxhash64("trait").alias("h")).join(F.broadcast(table_), "h")
    summed = met.groupBy("id", "own").agg(F.max("n").alias("n"), F.sum("m").cast("int").alias("m"), *[F.sum(f"w{i}").alias(f"w{i}") for i in k])
    rows = summed.select("id", "own", "n", *[f"w{i}" for i in k], "m", F.explode(F.array_repeat(F.lit(1), F.col("m"))))
    score = [F.col(f"w{i}") / F.col("m") / 1e9 + F.lit(constants[i] if weights else 0.0) for i in k]
    top = reduce(F.greatest, score) if len(score) > 1 else score[0]
    raw = [F.exp(s - top) for s in score]
    return rows.select("id", "own", "n", *[(r / sum(raw[1:], raw[0])).alias(f"p{i}") for i, r in enumerate(raw)])


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """x with a x = b for a small symmetric matrix; directions without any mass get 0."""
    n = len(b)
    m = [[*row, y] for row, y in zip(a, b, strict=True)]
    scale = max([abs(m[i][i]) for i in range(n)] + [1e-300])
    used = []
    for c in range(n):
        pivot = max((r for r in range(n) if r not in used), key=lambda r: abs(m[r][c]))
        if abs(m[pivot][c]) < 1e-12 * scale:
            continue
        used.append(pivot)
        for r in range(n):
            if r != pivot:
                f = m[r][c] / m[pivot][c]
                m[r] = [x - f * y for x, y in zip(m[r], m[pivot], strict=True)]
    x = [0.0] * n
    for c, r in zip((c for c in range(n)), used, strict=False):
        lead = next(k for k in range(n) if abs(m[r][k]) >= 1e-12 * scale)
        x[lead] = m[r][n] / m[r][lead]
    return x


def fit_rates(rows: DataFrame, targets: list[float], steps: int = STEPS) -> tuple[Column, list[float], float]:
    """(rate, reached, total): the rate as an expression over p0, p1, ..., the domains' expected tokens, and all tokens.

    Minimises the squared distance of the expected tokens from ``targets`` times
    the corpus's tokens, in the metric in which the rows with a positive rate
    move alike in all directions; a step is r <- max(0, r - p . m), where m solves
    that metric for the current distances. It starts at r = 1 and needs one pass a step.
    """
    k = range(len(targets))
    named = [F.sum(F.col("n") * F.col(f"p{i}")).alias(f"s{i}") for i in k]
    gram = [F.sum(F.col("n") * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"g{i}_{j}") for i in k for j in k if i <= j]
    found = rows.agg(F.sum("n").alias("n"), *named, *gram).first()
    total = float(found["n"] or 0)
    g = [[float(found[f"g{min(i, j)}_{max(i, j)}"] or 0) for j in k] for i in k]
    aims = [t * total for t in targets]
    rate = F.lit(1.0)
    reached = [float(found[f"s{i}"] or 0) for i in k]
    for _ in range(steps):
        gaps = [r - a for r, a in zip(reached, aims, strict=True)]
        if total == 0 or max(map(abs, gaps)) <= TOLERANCE * total:
            break
        move = _solve(g, gaps)
        rate = F.greatest(F.lit(0.0), rate - sum((F.col(f"p{i}") * F.lit(move[i]) for i in k[1:]), F.col("p0") * F.lit(move[0])))
        # the next step's metric is that of the rows that can still move both ways
        free = F.when(rate > 0, F.col("n")).otherwise(0)
        sums = [F.sum(F.col("n") * F.col(f"p{i}") * rate).alias(f"s{i}") for i in k]
        gram = [F.sum(free * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"g{i}_{j}") for i in k for j in k if i <= j]
        now = rows.agg(*sums, *gram).first()
        reached = [float(now[f"s{i}"] or 0) for i in k]
        g = [[float(now[f"g{min(i, j)}_{max(i, j)}"] or 0) for j in k] for i in k]
    return rate, reached, total


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row for each row of ``docs``: id, ``n_tokens``, ``p_<domain>``, ``rate``, ``copies``,
    ``reached_<domain>`` (and ``own``, a handle of the row's id and text).

    ``rate`` is how often the document is to be taken, ``copies`` a whole number
    with that mean, by a hash of the id. ``reached_<domain>`` is the share of the
    corpus's tokens that the rates give the domain, the same in every row: targets
    that no rates can meet are met as nearly as least squares allows. Rows with
    equal ids and texts get equal values. Null and empty texts have no tokens;
    without labels all posteriors are even; an empty table gives no rows.
    """
    targets = targets or TARGETS
    names = tuple(targets)
    rows = cut(posteriors(docs, fit(docs, labels, id_col, text, names, train_rows), id_col, text))
    rate, reached, total = fit_rates(rows, [targets[d] for d in names])
    drawn = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    out = rows.select("id", "own", "n", *[f"p{i}" for i in range(len(names))], F.greatest(F.lit(0.0), rate).alias("rate"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_tokens"), *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(names)],
        "rate", F.floor(F.col("rate") + drawn).cast("int").alias("copies"),
        *[F.lit(reached[i] / total if total else 0.0).alias(f"reached_{d}") for i, d in enumerate(names)], "own",
    )


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors, rate and copies of every document, and the shares that the rates reach."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("own")


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it.

    Rows with a null id or text are mixed like others, equal rows alike; an empty table stays empty.
    """
    own, of, copies = fresh("own", docs.columns), fresh("of", docs.columns), fresh("copies", docs.columns)
    mixed = mix(docs, table(spark, sf_dir, "labels")).select(F.col("own").alias(own), F.col("doc_id").alias(of), F.col("copies").alias(copies)).where(F.col(copies) > 0).distinct()
    joined = docs.withColumn(own, handle("doc_id", "text")).join(mixed.hint("shuffle_hash").withColumnRenamed(own, own + "_of"), (F.col(own) == F.col(own + "_of")) & col("doc_id").eqNullSafe(F.col(of)))
    return joined.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[col(c) for c in docs.columns])


QUERIES = {"op4_source_mixing": op4_source_mixing}
SQL: dict[str, str] = {}
