"""Mixing documents to target weights by soft domain membership (operator 9).

Native: DataFrame and SQL functions only.  A shrunken naive Bayes model over hashed words and
a few binned measures, counted from a labelled table, gives every document its domain
posteriors.  Nonnegative document rates are then fitted by projected gradient least squares
so that the expected token total of every domain meets its target.

A gradient needs the D domain totals only, so each step is one aggregate over the table of
posteriors, and a document's rate is a nested expression over the steps' D-vectors.  The
steps work on totals whitened by the domains' Gram matrix: without the bound at zero one
step would do, with it a few more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import written

BUCKETS = 8192
SHRINK = 4.0  # tokens of the overall mix added to every bucket of every domain
REPEAT = 3  # how often a measure's bin counts among the words
IN_GROUP = 65_536  # rows of a group within which copies are drawn
SCALE = 256  # evidence is added up in steps of 1 / SCALE
WHITE = " \t\n\u000B\f\r"
OWN = ("drawn_by", "n_tokens", "posterior", "rate", "copies", "group_", "upto_")
MARKS, CAPITALS = "[!-/:-@\\[-`{-~]", "[A-Z]"


def hashes(text: Column) -> Column:
    """Hashes of a whole text's lower-cased words, then of its bins of punctuation, capitals and repetition."""
    plain = F.lower(F.btrim(text, F.lit(WHITE)))
    words = F.when(plain == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(plain, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: F.xxhash64(w)))
    length = F.greatest(F.length(text), F.lit(1))

    def bin_of(name: str, share: Column) -> Column:
        return F.array_repeat(F.xxhash64(F.concat(F.lit(f"\u0001{name}="), F.floor(F.sqrt(share) * 20).cast("string"))), REPEAT)

    marks = bin_of("marks", (F.length(text) - F.length(F.regexp_replace(text, MARKS, ""))) / length)
    capitals = bin_of("capitals", (F.length(text) - F.length(F.regexp_replace(text, CAPITALS, ""))) / length)
    fresh = bin_of("fresh", F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)))
    return F.concat(words, marks, capitals, fresh)


def bucket(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(BUCKETS)).cast("int")


def constant_array(values: list[int]) -> Column:
    """An array of longs as one literal; the optimizer folds it."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def summed(hashed: Column, weights: Column) -> Column:
    """Sum of the weights of an array's hashes."""
    return F.aggregate(hashed, F.lit(0).cast("bigint"), lambda total, h: total + F.get(weights, bucket(h)))


@dataclass
class DomainModel:
    """log prior of each domain and its log ratios to the overall mix by bucket."""

    domains: list[str]
    prior: list[float]
    ratios: list[list[float]]

    def logits(self, hashed: Column, temper: float) -> list[Column]:
        """Of each domain over the first, from a column of hashes; the words' evidence is divided by temper.

        Two domains' evidence, in whole steps, shares one long, so that one pass over the
        words adds up both.
        """
        steps = [[round((x - y) * SCALE) for x, y in zip(r, self.ratios[0], strict=True)] for r in self.ratios]
        out = [F.lit(0.0)]
        for i in range(1, len(self.domains), 2):
            pair = i + 1 < len(self.domains)
            total = summed(hashed, constant_array([a + (b << 32) for a, b in zip(steps[i], steps[i + 1] if pair else [0] * BUCKETS, strict=True)]))
            low = F.pmod(total + (1 << 31), F.lit(1 << 32)) - (1 << 31)
            out.append(F.lit(self.prior[i] - self.prior[0]) + low / (SCALE * temper))
            if pair:
                out.append(F.lit(self.prior[i + 1] - self.prior[0]) + F.shiftright(total - low, 32) / (SCALE * temper))
        return out


def softmax(logits: Column) -> Column:
    most = F.array_max(logits)
    shares = F.transform(logits, lambda x: F.exp(x - most))
    total = F.aggregate(shares, F.lit(0.0), lambda s, x: s + x)
    return F.transform(shares, lambda x: x / total)


def fit_domains(sample: DataFrame, text: str = "text", domain: str = "domain") -> DomainModel:
    """Counts of a labelled sample, which its caller bounds; what comes to the driver has domains * BUCKETS numbers."""
    import math

    rows = sample.where(F.col(domain).isNotNull()).select(F.col(domain).cast("string").alias("d"), F.coalesce(text, F.lit("")).alias("t"))
    sizes = {r.d: r.n for r in rows.groupBy("d").agg(F.count("*").alias("n")).collect()}
    domains = sorted(sizes)
    counts: dict[str, dict[int, int]] = {d: {} for d in domains}
    for r in rows.select("d", F.explode(hashes(F.col("t"))).alias("h")).groupBy("d", bucket(F.col("h")).alias("b")).agg(F.count("*").alias("n")).collect():
        counts[r.d][r.b] = r.n
    every = [sum(counts[d].get(b, 0) for d in domains) for b in range(BUCKETS)]
    total = max(1, sum(every))
    ratios = []
    for d in domains:
        own = max(1, sum(counts[d].values()))
        ratios.append([math.log((counts[d].get(b, 0) + SHRINK) / (own * every[b] / total + SHRINK)) for b in range(BUCKETS)])
    docs = sum(sizes.values())
    return DomainModel(domains, [math.log((sizes[d] + 1) / (docs + len(domains))) for d in domains], ratios)


def solved(matrix: list[list[float]], ridge: float = 1e-9) -> list[list[float]]:
    """Inverse of a small symmetric matrix with a ridge relative to its trace."""
    n = len(matrix)
    lift = ridge * max(sum(matrix[i][i] for i in range(n)), 1e-300)
    rows = [[*map(float, matrix[i]), *(1.0 if i == j else 0.0 for j in range(n))] for i in range(n)]
    for i in range(n):
        rows[i][i] += lift
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(rows[r][i]))
        rows[i], rows[p] = rows[p], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n):
            if r != i:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i], strict=True)]
    return [r[n:] for r in rows]


@dataclass
class Mix:
    """Rates as a column of the table, with the totals that they reach."""

    table: DataFrame
    rate: Column
    domains: list[str]
    targets: list[float]
    totals: list[float]
    steps: int


def fit_rates(table: DataFrame, domains: list[str], targets: dict[str, float], most_steps: int = 25, tolerance: float = 1e-4, least: Column | None = None) -> Mix:
    """Projected gradient over table (n_tokens, posterior): totals of targets as tokens; domains without a target keep theirs.

    least: lower bound of a row's rate, at most 1; zero by default.
    """
    d = range(len(domains))
    p = [F.col("posterior")[i] for i in d]
    n = F.col("n_tokens").cast("double")
    first = table.agg(*[F.sum(n * p[i]).alias(f"t{i}") for i in d], *[F.sum(n * p[i] * p[j]).alias(f"g{i}_{j}") for i in d for j in d]).first()
    totals = [first[f"t{i}"] or 0.0 for i in d]
    inverse = solved([[first[f"g{i}_{j}"] or 0.0 for j in d] for i in d])
    goal = [float(targets.get(name, totals[i])) for i, name in enumerate(domains)]
    rate: Column = F.lit(1.0)
    scale, steps = max(1.0, sum(goal)), 0
    for steps in range(most_steps + 1):
        error = [totals[i] - goal[i] for i in d]
        if steps == most_steps or max(map(abs, error), default=0.0) <= tolerance * scale:
            break
        step = [sum(inverse[i][j] * error[j] for j in d) for i in d]
        move = sum((F.lit(step[i]) * p[i] for i in d), F.lit(0.0))
        rate = F.greatest(F.lit(0.0) if least is None else least, rate - move)
        sums = table.agg(*[F.sum(rate * n * p[i]).alias(f"t{i}") for i in d]).first()
        totals = [sums[f"t{i}"] or 0.0 for i in d]
    return Mix(table, rate, domains, goal, totals, steps)


def with_copies(table: DataFrame, rows: int) -> DataFrame:
    """table (n_tokens, posterior, rate, drawn_by, ...) of so many rows with copies: each the rate's floor or the next number, with the rate as expectation.

    Drawn systematically: rows are dealt into groups of about IN_GROUP; within one, ordered by
    domain and length, copies are the steps of the rates' running sum from a start drawn for
    the group.  Rows alike make up for each other's fractions, so the totals by domain come
    out as fitted up to a few documents a group, whereas draws for each row would add up their
    chances.  Rows, not keys, are dealt, so no key makes a large group; table is read as stored,
    so a task that is run again deals alike.
    """
    groups = max(1, -(-rows // IN_GROUP))
    dealt = table.withColumn("group_", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    largest = F.array_position("posterior", F.array_max("posterior"))
    by = Window.partitionBy("group_").orderBy(largest, "n_tokens", "drawn_by")
    start = (F.pmod(F.xxhash64(F.col("group_"), F.lit(17)), F.lit(1_000_000)) + 0.5) / 1_000_000
    upto = dealt.withColumn("upto_", start + F.sum("rate").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    before = F.coalesce(F.lag("upto_").over(by), start)
    return upto.withColumn("copies", (F.floor("upto_") - F.floor(before)).cast("int")).drop("group_", "upto_")


def evened(table: DataFrame, totals: list[float], tolerance: float = 0.003, most_rounds: int = 24) -> DataFrame:
    """table (n_tokens, posterior, rate, copies, ...), read as stored, with a few rows' copies moved to the other whole number beside their rate, so that each domain's tokens come to totals.

    In a round every domain that is off by more than tolerance moves the one of its rows whose
    tokens come nearest to what it is off by.  Large tables are even enough from the draw and
    need no round; small ones, where one document is a percent, need some.  Rounds are bounded
    and move a row for each domain, so the rows named in the result are few.
    """
    d = range(len(totals))
    n = F.col("n_tokens").cast("double")
    own = F.array_position("posterior", F.array_max("posterior")) - 1
    have = table.agg(*[F.sum(F.col("copies") * n * F.col("posterior")[i]).alias(f"t{i}") for i in d]).first()
    off = [totals[i] - (have[f"t{i}"] or 0.0) for i in d]
    moved: dict[int, int] = {}
    rows = table.withColumn("row_", F.monotonically_increasing_id())
    for _ in range(most_rounds):
        wide = [i for i in d if abs(off[i]) > tolerance * max(1.0, totals[i])]
        if not wide:
            break
        best = []
        for i in wide:
            tokens = n * F.col("posterior")[i]
            may = (own == i) & (F.col("copies") < F.col("rate") if off[i] > 0 else F.col("copies") > F.col("rate")) & (tokens > 0) & (tokens < 2 * abs(off[i]))
            if moved:
                may = may & ~F.col("row_").isin(list(moved))
            best.append(F.min(F.when(may, F.struct(F.abs(tokens - abs(off[i])), "row_", "n_tokens", "posterior"))).alias(f"b{i}"))
        found = rows.agg(*best).first()
        if not any(found[f"b{i}"] for i in wide):
            break
        for i in wide:
            if row := found[f"b{i}"]:
                step = 1 if off[i] > 0 else -1
                if row.row_ in moved or abs(off[i] - step * row.n_tokens * row.posterior[i]) >= abs(off[i]):
                    continue
                moved[row.row_] = step
                off = [off[j] - step * row.n_tokens * row.posterior[j] for j in d]
    if not moved:
        return table
    step = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in moved.items() for x in pair]), F.col("row_")), F.lit(0))
    return rows.withColumn("copies", (F.col("copies") + step).cast("int")).drop("row_")


def memberships(df: DataFrame, model: DomainModel, key: str = "doc_id", text: str = "text", temper: float = 2.0, carry: list[str] | None = None) -> DataFrame:
    """A written table (carry..., drawn_by, n_tokens, posterior): hash of key and text, words of every whole text, its domain posteriors.

    Columns of carry with one of the names OWN are replaced.
    """
    carry = [c for c in ([key] if carry is None else carry) if c.lower() not in OWN]
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    hashed = df.select(*carry, F.xxhash64(F.col(key), whole).alias("drawn_by"), hashes(whole).alias("posterior"))  # hashes until the next line
    logits = F.array(*model.logits(F.col("posterior"), temper)) if model.domains else F.array().cast("array<double>")
    table = hashed.select(*carry, "drawn_by", (F.size("posterior") - 3 * REPEAT).cast("long").alias("n_tokens"), logits.alias("posterior"))
    return written(table.select(*carry, "drawn_by", "n_tokens", softmax(F.col("posterior")).alias("posterior")), "memberships")


def mixed(df: DataFrame, model: DomainModel, weights: dict[str, float], key: str = "doc_id", text: str = "text", total: float | None = None, total_of: str | None = None, carry: list[str] | None = None, whole: str | None = None) -> DataFrame:
    """(carry..., n_tokens, posterior, rate, copies) for every row of df.

    Copies have the rate as expectation (see with_copies) and come to the domains' totals (see evened).  whole: a domain whose rows, those that belong to it
    more than to all others, have a rate of 1 at least.

    weights: share of each domain of the model; domains without one get none.  The mix has
    total tokens; by default as many as df, or as many as leave the domain total_of the
    tokens it has.  Null and empty texts have no tokens, the posterior of their empty
    evidence, and the rate of that posterior; repeated rows have equal rates.  Targets that no
    rates reach (a domain that no document belongs to) are met as nearly as least squares can.
    Columns of carry with a name of the result's own are replaced.
    """
    table = memberships(df, model, key, text, carry=carry)
    names = model.domains
    if names:
        now = table.agg(F.count("*").alias("rows"), *[F.sum(F.col("n_tokens") * F.col("posterior")[i]).alias(f"t{i}") for i in range(len(names))]).first()
        have = {name: now[f"t{i}"] or 0.0 for i, name in enumerate(names)}
        share = {name: weights.get(name, 0.0) / max(1e-12, sum(weights.values())) for name in names}
        if total is None:
            total = have[total_of] / share[total_of] if total_of in have and share[total_of] > 0 else sum(have.values())
        least = F.when(F.col("posterior")[names.index(whole)] > 0.5, 1.0).otherwise(0.0) if whole in names else None
        fitted = fit_rates(table, names, {name: share[name] * total for name in names}, least=least)
        drawn = written(with_copies(table.withColumn("rate", fitted.rate.cast("double")), now.rows).drop("drawn_by"), "copies")
        return evened(drawn, fitted.totals)
    # nothing is labelled: every document stays as it is
    return table.withColumn("rate", F.lit(1.0)).withColumn("copies", F.lit(1)).drop("drawn_by")
