"""Mixing by soft membership: posteriors of domains, then document rates whose expected totals match targets.

Domains are named by paths: ``clean/en`` is a part of ``clean``. A naive Bayes classifier on the presence of
words, word shapes and the share of distinct words is fitted to a labelled table, one split for each level
of the paths, and gives every document a probability for each domain. With n_i the tokens of document i and
p_id its probability of domain d, rates r_i >= 0 are fitted so that the sums of n_i r_i p_id come as near the
target totals as they can, in least squares. Only built-in DataFrame functions touch rows.

Only features that most of their labelled documents share with one domain are evidence. What a document lacks
counts at the first level alone, whose features are the same in all languages; which language it is in follows
from what is there, so that short texts and those with rare words are not taken for another domain.

The descent starts from rate 1, weighs a domain's miss by the inverse of its own tokens and measures rates in
tokens. Explicit gradient steps need some 20,000 passes to the least miss, since domains overlap: a step that
takes little of a domain pushes all others. So the steps are implicit: a step goes along the gradient at its own
end and is projected onto r >= 0, which is right for steps of any length. Where a step ends follows from as many
numbers as there are domains, the push of each; Newton's method finds them, with one aggregation of sums of the
domains and their pairs a round. Steps get ten times longer until the projected gradient vanishes: a dozen or two
aggregations in all, at any size. The driver sees only sums. A document's rate follows from its probabilities and
the list of steps, so the fitted rates need no join, and plans don't grow.

With a ``pull`` the square distance of rates from 1 counts too, and one step of length 1 / pull is its exact minimum.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, documents, unused

QUERY = "op1_soft_mixing"

#: Domains with their target shares of tokens: languages nearer to each other than they come, little of low quality, nothing toxic.
TARGETS = {"clean/en": 0.52, "clean/de": 0.165, "clean/fr": 0.16, "clean/es": 0.14, "low": 0.015, "toxic": 0.0}
#: Domains that must not shrink: the total is the smallest at which each of them keeps at least its tokens.
WHOLE = ("clean/en", "clean/de", "clean/fr", "clean/es")
#: The classifier is fitted to at most so many labelled documents, those with the smallest id hashes.
LABELLED = 20_000
#: A feature counts when at least so many labelled documents hold it, and this share of one domain's at each level,
MIN_FREQUENCY, FLOORS = 4, (0.015, 0.25)
#: when that domain has this share of those documents, and this many times its share of all at each level,
PURITY, LIFTS = 0.7, (2.0, 1.2)
#: and when its G statistic is beyond chance.
MIN_G = 12.0
#: The first step's length, how much longer each next is, and the longest; a fit ends when its projected gradient's norm is this share of the rates'.
LENGTH, LONGER, LONGEST, TOLERANCE = 1e3, 10.0, 1e9, 1e-6
#: Rounds of Newton's method for a step; two to five are usual.
ROUNDS = 60
#: How strongly rates are held to 1: clean documents stay, at a miss of about a thousandth of all tokens. Without it
#: the miss is least, but some clean documents are given up for the traces of other domains that they may hold.
PULL = 1e-3
#: Rates this near a whole number count as that number when documents are drawn: no more than rounding errors.
SNAP = 1e-6

_BLANK = r"[\x20\x09-\x0D]+"


def _sum(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def domains_of(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, domain: toxic before low before clean/<lang>; rows that repeat an id agree on the worst.

    Rows without an id or labels are left out, as are clean documents without a language.
    """
    worst = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    langs = docs.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, F.concat(F.lit("clean/"), "lang"))
    return worst.where("doc_id IS NOT NULL").join(langs, "doc_id").select("doc_id", domain.alias("domain")).where("domain IS NOT NULL")


def tokens(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.filter(F.split(text, _BLANK), lambda x: x != "")


def _words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}]+")


def _shapes(text: Column) -> Column:
    return F.split(F.regexp_replace(F.regexp_replace(text, r"[\p{L}\p{M}]+", "a"), r"\p{N}+", "0"), _BLANK)


def _tenths(tokens: Column, distinct: Column) -> Column:
    n = F.size(tokens)
    below = (F.floor(10 * distinct / n) + 1).cast("int")
    return F.when((n > 0) & (10 * distinct < 6 * n), F.transform(F.sequence(below, F.lit(6)), lambda x: F.concat(F.lit("~"), x))).otherwise(F.array().cast("array<string>"))


def features(text: Column, tokens: Column) -> Column:
    """Lower-case words without what is not a letter; after ^ the tokens' shapes; after ~ each tenth up to six that the share of distinct tokens is below."""
    marked = F.transform(F.array_remove(_shapes(text), ""), lambda x: F.concat(F.lit("^"), x))
    return F.array_distinct(F.concat(F.array_remove(_words(text), ""), marked, _tenths(tokens, F.size(F.array_distinct(tokens)))))


# ---- the classifier ----


@dataclass
class Split:
    """One level of the paths below ``parent``: its parts, their log weights without any feature, and each feature's log weights and hash."""

    parent: str
    parts: list[str]
    priors: list[float]
    weights: dict[str, list[float]]
    hashes: dict[str, int]


def _splits(domains: list[str]) -> list[tuple[str, list[str]]]:
    """(parent, parts) of each inner node of the paths, from the top."""
    found: dict[str, list[str]] = {}
    for domain in domains:
        steps = domain.split("/")
        for i, step in enumerate(steps):
            parts = found.setdefault("/".join(steps[:i]), [])
            if step not in parts:
                parts.append(step)
    return sorted(found.items(), key=lambda x: (x[0].count("/") + bool(x[0]), x[0]))


def fit(docs: DataFrame, labelled: DataFrame, domains: list[str], ws: Workspace) -> list[Split]:
    """The classifier, fitted to the documents whose ids are labelled with one of the domains.

    A part without a labelled document has a prior of almost nothing and neutral weights.
    """
    chosen = labelled.where(F.col("domain").isin(domains)).select("doc_id", "domain").orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(LABELLED)
    # At most LABELLED rows of two short columns.
    known = docs.where("doc_id IS NOT NULL").join(F.broadcast(ws.table(chosen, "chosen")), "doc_id").select("domain", F.coalesce("text", F.lit("")).alias("text"))
    known = known.select("domain", "text", tokens(F.col("text")).alias("tokens")).select("domain", features(F.col("text"), F.col("tokens")).alias("features"))
    known = ws.table(known, "known")
    count = [F.count(F.when(F.col("domain") == d, 1)).alias(f"n_{i}") for i, d in enumerate(domains)]
    row = known.agg(*count).first()
    sizes = dict(zip(domains, map(float, row), strict=True))
    table = ws.table(known.select("domain", F.explode("features").alias("feature")).groupBy("feature").agg(*count), "feature_counts")
    out = []
    for parent, parts in _splits(domains):
        under = lambda part: [i for i, d in enumerate(domains) if f"{d}/".startswith(f"{parent}/{part}/" if parent else f"{part}/")]  # noqa: B023, E731
        size = [sum(sizes[domains[i]] for i in under(p)) for p in parts]
        total = sum(size)
        priors = [float(np.log((s + 0.01) / (total + 0.01 * len(parts)))) for s in size]
        n = [_sum([F.col(f"n_{i}") for i in under(p)]) for p in parts]
        level = min(parent.count("/") + bool(parent), len(FLOORS) - 1)
        picked = _telling(table.select("feature", *[x.cast("double").alias(f"c_{i}") for i, x in enumerate(n)]), size, FLOORS[level], LIFTS[level])
        rows = picked.collect()  # features of LABELLED documents at most
        c = np.array([r[2:] for r in rows], float).reshape(len(rows), len(parts))
        here = c.sum(1, keepdims=True)
        # A part's rate of a feature is drawn towards the overall one, as if two more documents had it.
        rates = np.minimum((c + 2 * here / max(total, 1.0)) / (np.array(size) + 2), 0.999)
        if level:
            weights = np.log(rates / (here / max(total, 1.0)))
        else:
            weights = np.log(rates / (1 - rates))
            priors = (np.array(priors) + np.log(1 - rates).sum(0)).tolist()
        out.append(Split(parent, parts, priors, {r[0]: w for r, w in zip(rows, weights.tolist(), strict=True)}, {r[0]: r[1] for r in rows}))
    return out


def _telling(table: DataFrame, size: list[float], floor: float, lift: float) -> DataFrame:
    """The features that most of their documents share with one part, and that enough of the part's documents have."""
    total = max(sum(size), 1.0)
    here = F.col("here")
    table = table.withColumn("here", _sum([F.col(f"c_{i}") for i in range(len(size))])).where(here >= MIN_FREQUENCY)
    pure = [(F.col(f"c_{i}") >= PURITY * here) & (F.col(f"c_{i}") * total >= lift * here * s) & (F.col(f"c_{i}") >= floor * s) for i, s in enumerate(size)]
    terms = []
    for i, s in enumerate(size):  # G: how far the parts' shares of a feature's documents are from their sizes, absences included
        for seen, of in ((F.col(f"c_{i}"), here), (s - F.col(f"c_{i}"), total - here)):
            expected = of * (s / total)
            terms.append(F.when((seen > 0) & (expected > 0), 2 * seen * F.log(seen / expected)).otherwise(0.0))
    return table.where(reduce(lambda a, b: a | b, pure)).where(_sum(terms) >= MIN_G).select("feature", F.xxhash64("feature"), *[f"c_{i}" for i in range(len(size))])


def _slots(keys: list[int]) -> tuple[int, np.ndarray, np.ndarray]:
    """(shift, moves, places): each key is at ((key >>> shift) ^ moves[key & (len(moves) - 1)]) & (len(places) - 1), alone."""
    size = 1 << max(1, (2 * len(keys)).bit_length())
    h = np.array(keys, np.int64).view(np.uint64)
    while True:
        for shift in range(16, 48, 2):
            spread = ((h >> np.uint64(shift)) & np.uint64(size - 1)).astype(np.int64)
            lists: dict[int, list[int]] = {}
            for i, b in enumerate((h & np.uint64(size // 2 - 1)).tolist()):
                lists.setdefault(b, []).append(i)
            moves, places = np.zeros(max(size // 2, 1), np.int64), np.zeros(size, np.int64)
            taken = np.zeros(size, bool)
            for b, some in sorted(lists.items(), key=lambda x: -len(x[1])):
                at = spread[some]
                move = next((m for m in range(size) if not taken[at ^ m].any()), None) if len(set(at.tolist())) == len(some) else None
                if move is None:
                    break
                moves[b], taken[at ^ move] = move, True
                places[at ^ move] = h[some].view(np.int64)
            else:
                return shift, moves, places
        size *= 2


def _array(values: np.ndarray, kind: str) -> Column:
    """A constant array, folded by the optimizer."""
    return F.split(F.lit(",".join(repr(x) for x in values.tolist())), ",").cast(f"array<{kind}>")


def posteriors(text: Column, tokens: Column, splits: list[Split], domains: list[str]) -> tuple[Column, callable]:
    """(the document's telling features, a function from a column of those to the array of its domains' probabilities)."""
    hashes = {f: h for s in splits for f, h in s.hashes.items()}
    shift, moves, places = _slots(sorted({*hashes.values(), 1}))
    names = sorted(hashes)
    order = {hashes[f]: i for i, f in enumerate(names)}
    move, index = _array(moves, "bigint"), _array(np.array([order.get(k, -1) for k in places.tolist()]), "int")
    slot = lambda h: F.shiftrightunsigned(h, shift).bitwiseXOR(F.get(move, h.bitwiseAND(F.lit(len(moves) - 1)).cast("int"))).bitwiseAND(F.lit(len(places) - 1)).cast("int")
    # No feature holds a space.
    known = lambda found, mark: F.array_intersect(found, F.split(F.lit(" ".join(sorted(f[len(mark) :] for f in hashes if f[0] == mark or not mark and f[0] not in "^~"))), " "))
    marked = F.transform(F.array_remove(known(_shapes(text), "^"), ""), lambda x: F.concat(F.lit("^"), x))
    shares = F.array_intersect(_tenths(tokens, F.size(F.array_distinct(tokens))), F.array(*[F.lit(f"~{i}") for i in range(7) if f"~{i}" in hashes]).cast("array<string>"))
    hits = F.transform(F.concat(F.array_remove(known(_words(text), ""), ""), marked, shares), lambda x: F.get(index, slot(F.xxhash64(x))))

    def probabilities(hits: Column) -> Column:
        chance: dict[str, Column] = {}
        for split in splits:
            sums = []
            for i, prior in enumerate(split.priors):
                table = _array(np.array([split.weights[f][i] if f in split.weights else 0.0 for f in names] or [0.0]), "double")
                sums.append(F.aggregate(hits, F.lit(prior), lambda acc, at: acc + F.get(table, at)))  # noqa: B023
            top = F.greatest(*sums) if len(sums) > 1 else sums[0]
            powers = [F.exp(s - top) for s in sums]
            for part, power in zip(split.parts, powers, strict=True):
                path = f"{split.parent}/{part}" if split.parent else part
                chance[path] = (power / _sum(powers)) * chance.get(split.parent, F.lit(1.0))
        return F.array(*[chance[d] for d in domains])

    return hits, probabilities


# ---- the rates ----


@dataclass
class Fit:
    """Steps of the rates (a vector of the domains' pushes each), each domain's target and expected tokens at the fitted rates, and the projected gradient's norm as a share of the rates'."""

    steps: list[list[float]]
    targets: list[float]
    totals: list[float]
    residual: float


def rate(p: Column, steps: list[list[float]]) -> Column:
    """The rate of a document with these probabilities after the steps."""
    if not steps:
        return F.lit(1.0)
    pushes = F.transform(F.split(F.lit(";".join(",".join(map(repr, s)) for s in steps)), ";"), lambda s: F.split(s, ",").cast("array<double>"))
    push = lambda c: F.aggregate(F.zip_with(p, c, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return F.aggregate(pushes, F.lit(1.0), lambda r, c: F.greatest(F.lit(0.0), r + push(c)))


@dataclass
class _Sums:
    """At some rates: the domains' totals, the sums of n p_i p_j over rates beyond 0, those of n r^2, and of n times the square of the last step."""

    totals: np.ndarray
    pairs: np.ndarray
    squares: float
    moved: float


def _sums(table: DataFrame, steps: list[list[float]], k: int) -> _Sums:
    """One aggregation over the documents' n and p."""
    both = table.select("n", "p", rate(F.col("p"), steps).alias("r"), rate(F.col("p"), steps[:-1]).alias("before"))
    n, p, r = F.col("n").cast("double"), F.col("p"), F.col("r")
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    row = both.agg(
        F.sum(n * r * r),
        F.sum(n * (r - F.col("before")) * (r - F.col("before"))),
        *[F.sum(n * r * p[i]) for i in range(k)],
        *[F.sum(F.when(r > 0, n * p[i] * p[j]).otherwise(0.0)) for i, j in upper],
    ).first()
    values = [x or 0.0 for x in row]
    pairs = np.zeros((k, k))
    for (i, j), x in zip(upper, values[2 + k :], strict=True):
        pairs[i, j] = pairs[j, i] = x
    return _Sums(np.array(values[2 : 2 + k], float), pairs, values[0], values[1])


def _step(table: DataFrame, found: list[list[float]], here: _Sums, length: float, targets: np.ndarray, mass: np.ndarray, there: np.ndarray, tolerance: float) -> tuple[list[float], _Sums]:
    """The pushes of an implicit step from the rates after ``found``, and the sums at its end.

    The push c of each domain is ``length`` times its weighed miss at the end. That is where the convex function
    sum(c^2 mass) / (2 length) - targets c + sum(n r^2) / 2 is least; halved Newton steps never let it grow.
    """
    c = np.zeros(len(mass))
    at = np.flatnonzero(there)
    value = lambda c, s: float((c * c * mass)[at].sum() / (2 * length) - targets[at] @ c[at] + s.squares / 2)
    for _ in range(ROUNDS):
        slope = (mass * c / length - targets + here.totals)[at]
        if (slope * slope / mass[at]).sum() <= tolerance**2 * targets.sum():
            break
        bend = np.diag(mass[at] / length) + here.pairs[np.ix_(at, at)]
        move = np.linalg.solve(bend, -slope)
        now, part = value(c, here), 1.0
        while True:
            new = c.copy()
            new[at] += part * move
            sums = _sums(table, [*found, new.tolist()], len(mass))
            if value(new, sums) <= now + 1e-4 * part * float(slope @ move) + 1e-12 * abs(now) or part < 1e-6:
                break
            part /= 2
        c, here = new, sums
    return c.tolist(), here


def fit_rates(table: DataFrame, shares: list[float], whole: list[int], pull: float = 0.0, tolerance: float = TOLERANCE) -> Fit:
    """Steps to rates whose expected totals meet the shares; table: n (tokens), p (probabilities of each domain).

    The total is the smallest at which each domain of ``whole`` keeps its tokens, or today's where none has
    a share. Domains without a token in documents that most likely belong to them can't be drawn at any
    rate: they are left out of the fit, and the others keep their targets; ``Fit`` shows the miss. Rates have no upper bound.
    A fit that ends at the longest step shows by its ``residual`` how far it is from the least miss; with a pull the
    one step is the fit, and its residual is 0.
    """
    k = len(shares)
    row = table.agg(*[F.sum(F.when(F.col("p")[i] > 0.5, F.col("n"))).alias(f"x_{i}") for i in range(k)]).first()
    here = _sums(table, [], k)
    mass = here.totals
    there = np.array([bool(row[f"x_{i}"]) for i in range(k)]) & (mass > 0)
    kept = [i for i in whole if there[i] and shares[i] > 0]
    total = max((mass[i] / shares[i] for i in kept), default=mass.sum())
    targets = np.array(shares, float) * total
    found: list[list[float]] = []
    length, residual = 1 / pull if pull else LENGTH, 0.0
    while there.any() and length <= max(LONGEST, 1 / pull if pull else 0.0):
        push, here = _step(table, found, here, length, targets, mass, there, tolerance)
        if not any(push):
            residual = 0.0
            break
        found.append(push)
        residual = 0.0 if pull else (here.moved / max(here.squares, 1.0)) ** 0.5 / length
        if pull or residual <= tolerance:
            break
        length *= LONGER
    return Fit(found, targets.tolist(), here.totals.tolist(), residual)


def copies(rate: Column, key: Column) -> Column:
    """How often a document is drawn: its rate's whole part, and one more with the chance of the rest, by the key's hash."""
    near = F.round(rate)
    rate = F.when(F.abs(rate - near) <= SNAP, near).otherwise(rate)
    chance = F.pmod(F.xxhash64(key, F.lit("mixing")), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + chance).cast("long")


def _judged(docs: DataFrame, labelled: DataFrame, domains: list[str], ws: Workspace, *keep: str) -> tuple[DataFrame, str]:
    """A table of the kept columns and, in one more column that is returned by name, n and p of each row."""
    splits = fit(docs.select("doc_id", "text"), labelled, domains, ws)
    own = unused(docs, "mixing")
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(*[docs[c] for c in keep], F.struct(text.alias("text"), tokens(text).alias("tokens")).alias(own))
    hits, chances = posteriors(F.col(f"{own}.text"), F.col(f"{own}.tokens"), splits, domains)
    rows = rows.select(*keep, F.struct(F.size(f"{own}.tokens").cast("long").alias("n"), hits.alias("hits")).alias(own))
    return ws.table(rows.select(*keep, F.struct(F.col(f"{own}.n").alias("n"), chances(F.col(f"{own}.hits")).alias("p")).alias(own)), "posteriors"), own


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], ws: Workspace, whole: tuple[str, ...] = WHOLE, pull: float = PULL) -> DataFrame:
    """One row per input row: doc_id, n_tokens, p_<domain> ..., rate, copies.

    Tokens are runs of anything but ASCII white space. A null or empty text has none; its posterior is the
    prior and it weighs nothing in the fit. Null ids are rated but never count as labelled; repeated rows
    are rated alike. Without labels every domain is equally likely. An empty table gives an empty result;
    columns other than doc_id and text are ignored, whatever their names. Equal counts and ties of any kind
    don't matter: nothing is ordered but the labelled ids, by hash and id.
    """
    domains = list(targets)
    table, own = _judged(docs.select("doc_id", "text"), labelled, domains, ws, "doc_id")
    table = table.select("doc_id", F.col(f"{own}.n").alias("n"), F.col(f"{own}.p").alias("p"))
    fitted = fit_rates(table.select("n", "p"), [targets[d] for d in domains], [domains.index(d) for d in whole if d in domains], pull)
    table = table.withColumn("rate", rate(F.col("p"), fitted.steps))
    names = [F.col("p")[i].alias(f"p_{d.replace('/', '_')}") for i, d in enumerate(domains)]
    return table.select("doc_id", F.col("n").alias("n_tokens"), *names, "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def attained(rated: DataFrame, targets: dict[str, float]) -> dict[str, tuple[float, float, float]]:
    """Of each domain the target share of tokens, the share at the fitted rates and the share as drawn; ``rated`` is of ``mixing_rates``."""
    sums = [F.sum(F.col("n_tokens") * F.col(c) * F.col(f"p_{d.replace('/', '_')}")).alias(f"{c}_{d}") for c in ("rate", "copies") for d in targets]
    row = rated.agg(*sums).first()
    total = {c: sum(row[f"{c}_{d}"] or 0.0 for d in targets) or 1.0 for c in ("rate", "copies")}
    return {d: (share, *((row[f"{c}_{d}"] or 0.0) / total[c] for c in total)) for d, share in targets.items()}


def mix(docs: DataFrame, labelled: DataFrame, ws: Workspace, targets: dict[str, float] | None = None, whole: tuple[str, ...] = WHOLE, pull: float = PULL) -> DataFrame:
    """The documents as drawn: rows with no copy go, rows with several are repeated; all columns stay, whatever their names.

    Rows are judged as in ``mixing_rates``: null and empty texts by the prior, null ids and repeated rows like any
    other. The rows are written once with their probabilities, so no join brings texts and rates together.
    An empty table stays empty.
    """
    targets = targets or TARGETS
    domains = list(targets)
    table, own = _judged(docs, labelled, domains, ws, *docs.columns)
    pairs = table.select(F.col(f"{own}.n").alias("n"), F.col(f"{own}.p").alias("p"))
    fitted = fit_rates(pairs, [targets[d] for d in domains], [domains.index(d) for d in whole if d in domains], pull)
    drawn = table.withColumn(own, copies(rate(F.col(f"{own}.p"), fitted.steps), F.col("doc_id"))).where(F.col(own) > 0)
    return drawn.withColumn(own, F.explode(F.sequence(F.lit(1).cast("long"), F.col(own)))).drop(own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = domains_of(spark.read.parquet(f"{sf_dir}/labels.parquet"), docs)
    return mixing_rates(docs, labels, TARGETS, Workspace(spark, "soft-mixing"))


ORACLE_SQL = None
