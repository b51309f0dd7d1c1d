"""Splitting a labelled table over clients.

All functions carry only the columns they are given; join records back by id.
Random choices are hashes of (seed, salt, id), so a result is the same whatever
the partitioning.  Control numbers (clients x labels) are drawn on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.rng import exact_rank, numbered, permutation_keys, permuted, u
from ..sources.scratch import folder


def dirichlet_shares(labels: list[str], clients: int, alpha: float, seed: int) -> dict[str, np.ndarray]:
    """For each label the share of each client, Dirichlet(alpha), rounded to 12 digits."""
    rng = np.random.default_rng(seed)
    return {label: np.round(rng.dirichlet(np.full(clients, alpha)), 12) for label in labels}


def client_mixes(labels: list[str], clients: int, alpha: float, seed: int) -> dict[int, np.ndarray]:
    """For each client its label mix, Dirichlet(alpha)."""
    rng = np.random.default_rng(seed)
    return {c: rng.dirichlet(np.full(len(labels), alpha)) for c in range(clients)}


def bounds(shares: dict[str, np.ndarray]) -> list[tuple[str, int, float, float]]:
    """Rows ``label, client, lo, hi`` of the cumulative shares; the last hi is 1."""
    rows = []
    for label, p in shares.items():
        edges = [0.0, *np.round(np.cumsum(p), 12).tolist()]
        edges[-1] = 1.0
        rows += [(label, c, edges[c], edges[c + 1]) for c in range(len(p))]
    return rows


def dirichlet_assign(df: DataFrame, shares: dict[str, np.ndarray], seed: int = 0, salt: str = "dir", label: str = "label", id_col: str = "id") -> DataFrame:
    """Exact cover without a shuffle: a row's client is where its uniform falls
    in the cumulative shares of its label.  Rows of unknown labels are dropped."""
    spark = df.sparkSession
    cuts = [(k, [r[3] for r in bounds({k: p})]) for k, p in shares.items()]
    table = F.broadcast(spark.createDataFrame(cuts, f"{label} string, _cuts array<double>"))
    own = df.join(table, label).withColumn("_u", u(seed, salt, id_col))
    return own.withColumn("client", F.size(F.filter("_cuts", lambda c: c <= F.col("_u"))).cast("int")).drop("_cuts", "_u")


def multinomial_quotas(counts: dict[str, int], shares: dict[str, np.ndarray], seed: int) -> list[tuple[str, int, int, int]]:
    """Rows ``label, client, lo, hi``: consecutive rank ranges with multinomial sizes."""
    rng, rows = np.random.default_rng(seed), []
    for label, p in shares.items():
        at = 0
        for c, n in enumerate(rng.multinomial(counts.get(label, 0), p / p.sum())):
            rows.append((label, c, at, at + int(n)))
            at += int(n)
    return rows


def largest_remainder(n: int, p: np.ndarray) -> list[int]:
    """Sizes that add up to ``n``, closest to ``n * p``."""
    raw = n * p / p.sum()
    sizes = np.floor(raw).astype(int)
    order = np.lexsort((np.arange(len(p)), -(raw - sizes)))
    sizes[order[: n - sizes.sum()]] += 1
    return sizes.tolist()


def quota_assign(df: DataFrame, quotas: list[tuple[str, int, int, int]], seed: int = 0, salt: str = "quota", label: str = "label", id_col: str = "id") -> DataFrame:
    """A row goes to the client whose rank range in its label holds its shuffled rank."""
    table = F.broadcast(df.sparkSession.createDataFrame(quotas, f"{label} string, client int, lo long, hi long"))
    ranked = exact_rank(df.withColumn("_u", u(seed, salt, id_col)), [label], "_u", [id_col]).drop("_u")
    return ranked.join(table, label).filter("rank >= lo and rank < hi").drop("rank", "lo", "hi")


def label_counts(df: DataFrame, label: str = "label") -> dict[str, int]:
    """Rows of each label; the number of labels is small by contract."""
    return {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


def uniform_sampling(df: DataFrame, clients: int, sample_num: int = 0, seed: int = 0, id_col: str = "id") -> DataFrame:
    """Disjoint samples: client i gets ``sample_num`` rows (0: all) of the i-th
    of ``clients`` equal stretches of one shuffle."""
    n = df.count()
    each = n // clients
    take = sample_num or each
    if clients * take > n:
        raise ValueError(f"{clients} clients of {take} rows ask for more than {n}")
    ranked = exact_rank(df.withColumn("_u", u(seed, "uniform", id_col)), [], "_u", [id_col]).drop("_u")
    placed = ranked.withColumn("client", F.expr(f"cast(rank div {max(1, each)} as int)"))
    return placed.filter(f"client < {clients} and rank % {max(1, each)} < {take}").drop("rank")


def per_client(df: DataFrame, clients: int, sample_num: int) -> int:
    """Rows of a client: ``sample_num``, or an equal part of all where it is 0."""
    return sample_num or df.count() // clients


def iid_sampling(df: DataFrame, clients: int, sample_num: int = 0, seed: int = 0, id_col: str = "id") -> DataFrame:
    """Each client independently draws ``sample_num`` rows (0: an equal part, at most all)
    without replacement."""
    total = df.count()
    k = min(sample_num or total // clients, total)
    wanted = df.sparkSession.range(clients).select(F.col("id").cast("int").alias("client"), F.lit("").alias("_all"), F.lit(k).cast("long").alias("k"))
    drawn = draw(df.withColumn("_all", F.lit("")), wanted, seed, "iid", "_all", id_col).drop("_all")
    return drawn if set(df.columns) == {id_col} else drawn.join(df, id_col)


def chosen_classes(spark, labels: list[str], clients: int, alpha: int, seed: int) -> DataFrame:
    """``client, label``: the ``alpha`` classes of each client."""
    table = spark.range(clients).select(F.col("id").cast("int").alias("client"), F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))
    order = W.partitionBy("client").orderBy(u(seed, "classes", "client", "label"), "label")
    return table.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= alpha).drop("_r")


#: Most buckets of a label that drawn places are looked up in.
BUCKETS = 1 << 16


def draw(df: DataFrame, wanted: DataFrame, seed: int = 0, salt: str = "draw", label: str = "label", id_col: str = "id") -> DataFrame:
    """``client, label, id`` for ``wanted`` rows ``client, label, k``: k rows of
    the label without replacement, or with it where the label has fewer.

    Every client has its own keyed permutation of the places in a label's shuffled
    order, so clients draw independently of each other; what it draws are the places
    that its first k numbers go to.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("pool"))
    asked = wanted.filter("k > 0").join(F.broadcast(sizes), label)
    asked = asked.withColumn("keys", F.when(F.col("k") <= F.col("pool"), permutation_keys(seed, salt, "pool", "client", label)))
    steps = numbered(asked.select("client", label, "pool", "k", "keys"), "k", "nth", ["client", label])
    with_repl = F.floor(u(seed, salt + "-with", "client", label, "nth") * F.col("pool")).cast("long")
    own = permuted("nth", "pool", "keys", seed, salt, "client", label)
    places = steps.select("client", label, F.when(F.col("k") <= F.col("pool"), own).otherwise(with_repl).alias("place"))
    return at_places(df.select(id_col, label), places, seed, salt, label, id_col)


def at_places(df: DataFrame, places: DataFrame, seed: int, salt: str, label: str, id_col: str) -> DataFrame:
    """``client, label, id`` of ``places`` (``client, label, place``) in the shuffled order of
    each label.

    A label's rows lie in buckets of their uniform.  Counts of buckets tell which
    bucket holds a place, and only rows of such buckets are shuffled and ranked: with
    N rows and D places there are about sqrt(N D) of them and of buckets.
    """
    spark = df.sparkSession
    path = folder(spark, "places")
    places.write.parquet(path)
    places = spark.read.schema(places.schema).parquet(path)
    asked, held = places.count(), df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(label).alias("labels")).first()
    buckets = int(min(BUCKETS, max(64, (held.n * asked) ** 0.5 / max(1, held.labels))))
    own = df.withColumn("_u", u(seed, salt, id_col)).withColumn("_bucket", F.floor(F.col("_u") * buckets).cast("int"))
    before = W.partitionBy(label).orderBy("_bucket")
    cells = own.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.withColumn("_first", F.sum("_n").over(before) - F.col("_n")).withColumn("_width", F.expr(f"1 + sum(_n) over (partition by {label}) div {buckets}"))
    # A bucket stands in each stretch of places that it reaches into.
    stretches = cells.withColumn("_part", F.explode(F.expr("sequence(_first div _width, (_first + _n - 1) div _width)")))
    widths = cells.groupBy(label).agg(F.max("_width").alias("_width"))
    cut = places.join(F.broadcast(widths), label).withColumn("_part", F.expr("place div _width")).drop("_width")
    found = cut.join(stretches.drop("_width"), [label, "_part"]).filter("place >= _first and place < _first + _n")
    found = found.select("client", label, "_bucket", (F.col("place") - F.col("_first") + 1).alias("_nth"))
    needed = found.select(label, "_bucket").distinct()
    few = F.broadcast(needed) if held.labels * buckets <= 1 << 20 else needed
    rows = own.join(few, [label, "_bucket"], "left_semi")
    ranked = rows.withColumn("_nth", F.row_number().over(W.partitionBy(label, "_bucket").orderBy("_u", id_col)).cast("long"))
    return found.join(ranked, [label, "_bucket", "_nth"]).select("client", label, id_col)


def pathological_sampling(df: DataFrame, labels: list[str], clients: int, alpha: int, sample_num: int = 0, seed: int = 0) -> DataFrame:
    """Each client draws ``alpha`` classes and of each ``sample_num // alpha`` rows (0: of an
    equal part of all)."""
    k = per_client(df, clients, sample_num) // alpha
    wanted = chosen_classes(df.sparkSession, labels, clients, alpha, seed).withColumn("k", F.lit(k))
    return draw(df, wanted, seed, "patho")


def dirichlet_quotas(mixes: dict[int, np.ndarray], labels: list[str], sample_num: int) -> list[tuple[int, str, int]]:
    """``client, label, k``: rounded shares, capped by what is left; the last
    label takes the rest."""
    rows = []
    for client, q in mixes.items():
        left = sample_num
        for i, label in enumerate(labels):
            k = left if i == len(labels) - 1 else min(left, int(sample_num * q[i] + 0.5))
            rows.append((client, label, k))
            left -= k
    return rows


def dirichlet_sampling(df: DataFrame, labels: list[str], clients: int, alpha: float, sample_num: int = 0, seed: int = 0) -> DataFrame:
    """Each client draws a label mix of its own and ``sample_num`` rows by it (0: an equal
    part of all)."""
    quotas = dirichlet_quotas(client_mixes(labels, clients, alpha, seed), labels, per_client(df, clients, sample_num))
    return draw(df, df.sparkSession.createDataFrame(quotas, "client int, label string, k long"), seed, "dirov")


def stratified_round_robin(df: DataFrame, clients: int, seed: int = 0, label: str = "label", id_col: str = "id") -> DataFrame:
    """Rows of each label, shuffled, are dealt in turn; label i starts at client i."""
    ordinal = F.broadcast(df.select(label).distinct().withColumn("_l", F.dense_rank().over(W.orderBy(label)) - 1))
    ranked = exact_rank(df.withColumn("_u", u(seed, "strat", id_col)), [label], "_u", [id_col]).drop("_u")
    return ranked.join(ordinal, label).withColumn("client", F.pmod(F.col("rank") + F.col("_l"), F.lit(clients)).cast("int")).drop("rank", "_l")


def placements(df: DataFrame, labels: list[str], clients: int, alphas: list[float], seed: int = 0, label: str = "label", id_col: str = "id") -> tuple[DataFrame, Column]:
    """``df`` with what a column of ``stat, client`` arrays needs, and that column: the client of a
    row in the iid split (dealt in turn) and in a Dirichlet split for each alpha."""
    cuts = {f"dir_{a}": dirichlet_shares(labels, clients, a, seed) for a in alphas}
    rows = [(x, [[r[3] for r in bounds({x: shares[x]})] for shares in cuts.values()]) for x in labels]
    table = F.broadcast(df.sparkSession.createDataFrame(rows, f"{label} string, _cuts array<array<double>>"))
    dealt = stratified_round_robin(df.select(id_col, label), clients, seed, label, id_col).select(id_col, F.col("client").alias("_iid"))
    own = df.join(dealt, id_col).join(table, label).withColumn("_u", u(seed, "dir", id_col))
    at = lambda k: F.size(F.filter(F.col("_cuts")[k], lambda c: c <= F.col("_u"))).cast("int")
    stats = [F.struct(F.lit(name).alias("stat"), at(k).alias("client")) for k, name in enumerate(cuts)]
    return own, F.array(F.struct(F.lit("iid").alias("stat"), F.col("_iid").alias("client")), *stats)


def participation(spark, rounds: int, clients: int, rate: float | None = None, count: int | None = None, seed: int = 0) -> DataFrame:
    """``round, client``: the clients that take part, ``int(rate * clients)`` or
    ``count`` of them (all where that is more)."""
    k = min(clients, int(rate * clients) if count is None else count)
    grid = spark.range(rounds).select(F.col("id").cast("int").alias("round"), F.explode(F.sequence(F.lit(0), F.lit(clients - 1))).alias("client"))
    order = W.partitionBy("round").orderBy(u(seed, "part", "round", "client"), "client")
    return grid.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def evaluation_subset(df: DataFrame, most: int, seed: int = 0, id_col: str = "id") -> DataFrame:
    return df.withColumn("_u", u(seed, "eval", id_col)).orderBy("_u", id_col).limit(most).drop("_u")


def cycling_window(df: DataFrame, rounds: int, n: int, position: str = "pos") -> DataFrame:
    """Round r reads rows ``r*n .. r*n + n`` of the positions, modulo their number."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    steps = df.sparkSession.range(rounds).select(F.col("id").alias("round"), F.explode(F.sequence(F.col("id") * n, F.col("id") * n + n)).alias("at"))
    asked = steps.join(F.broadcast(total)).select(F.col("round").cast("int"), F.pmod("at", "total").alias(position))
    return asked.join(df, position)


def dominant_group(rows: DataFrame, units: DataFrame, unit: str = "unit", group: str = "grp", none: str = "__no_instance__") -> DataFrame:
    """``unit, grp``: the most frequent group of each unit, ties to the smallest
    name; units without rows get ``none``."""
    counts = rows.groupBy(unit, group).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(unit).agg(F.min_by(group, F.struct(-F.col("n"), F.col(group))).alias(group))
    return units.select(unit).join(top, unit, "left").select(unit, F.coalesce(group, F.lit(none)).alias(group))


# Repairs: planned on the clients x groups count matrix, rows moved by a join.


def count_matrix(df: DataFrame, clients: int, groups: list[str], group: str = "label") -> np.ndarray:
    """clients x groups counts; bounded by their number, not by the rows."""
    out = np.zeros((clients, len(groups)), np.int64)
    place = {g: i for i, g in enumerate(groups)}
    for r in df.groupBy("client", group).agg(F.count(F.lit(1)).alias("n")).collect():
        if r[group] in place:
            out[r["client"], place[r[group]]] = r["n"]
    return out


def smallest_allowed(n: int, clients: int) -> int:
    return max(1, int(0.05 * n / clients))


def retried_quotas(counts: dict[str, int], clients: int, alpha: float, seed: int, retries: int = 100) -> list[tuple[str, int, int, int]]:
    """Quotas redrawn until every client has enough rows; else the best draw:
    the largest smallest client, then the least spread."""
    labels, floor = sorted(counts), smallest_allowed(sum(counts.values()), clients)
    best, best_rank = None, None
    for k in range(retries):
        quotas = multinomial_quotas(counts, dirichlet_shares(labels, clients, alpha, seed + k), seed + k)
        sizes = np.zeros(clients, np.int64)
        for _, c, lo, hi in quotas:
            sizes[c] += hi - lo
        rank = (int(sizes.min()), -int(sizes.std()))
        if best_rank is None or rank > best_rank:
            best, best_rank = quotas, rank
        if sizes.min() >= floor:
            break
    return best or []


def small_client_plan(matrix: np.ndarray, floor: int) -> list[tuple[int, int, int, int]]:
    """``src, group, dst, k``: rows from the largest to the smallest client
    until every client has ``floor`` rows, the largest group of the source first."""
    now, moves = matrix.copy(), {}
    while now.sum(1).min() < floor and now.sum(1).max() > floor:
        dst, src = int(now.sum(1).argmin()), int(now.sum(1).argmax())
        group = int(now[src].argmax())
        k = int(min(floor - now[dst].sum(), now[src].sum() - floor, now[src, group]))
        now[src, group] -= k
        now[dst, group] += k
        moves[src, group, dst] = moves.get((src, group, dst), 0) + k
    return [(*key, k) for key, k in moves.items()]


def empty_client_plan(matrix: np.ndarray, groups: list[str]) -> list[tuple[int, int, int, int]]:
    """Each empty client gets one row of the largest client's dominant group
    (ties: the greatest name)."""
    now, moves = matrix.copy(), {}
    for dst in np.flatnonzero(now.sum(1) == 0).tolist():
        src = int(now.sum(1).argmax())
        if now[src].sum() < 2:
            break
        group = max(range(len(groups)), key=lambda g: (now[src, g], groups[g]))
        now[src, group] -= 1
        now[dst, group] += 1
        moves[src, group, dst] = moves.get((src, group, dst), 0) + 1
    return [(*key, k) for key, k in moves.items()]


def constraint_plan(matrix: np.ndarray, least_groups: int, least_units: int, rounds: int = 10) -> tuple[list[tuple[int, int, int, int]], list[dict]]:
    """Moves and unmet limits: first every client gets ``least_groups`` distinct
    groups, the globally most frequent missing ones first, then ``least_units``
    units.  A donor is one that would least break either limit, then the largest."""
    now, moves = matrix.copy(), {}

    def move(src: int, group: int, dst: int, k: int) -> None:
        now[src, group] -= k
        now[dst, group] += k
        moves[src, group, dst] = moves.get((src, group, dst), 0) + k

    frequency = matrix.sum(0)
    for _ in range(rounds):
        changed = False
        for dst in range(len(now)):
            missing = sorted(np.flatnonzero((now[dst] == 0) & (frequency > 0)), key=lambda g: (-frequency[g], g))
            for group in missing:
                if (now[dst] > 0).sum() >= least_groups:
                    break
                donors = [c for c in range(len(now)) if c != dst and now[c, group] > 0]
                if donors:
                    src = min(donors, key=lambda c: (now[c].sum() - 1 < least_units, now[c, group] == 1 and (now[c] > 0).sum() <= least_groups, -now[c].sum(), c))
                    move(src, int(group), dst, 1)
                    changed = True
        for dst in range(len(now)):
            while (short := least_units - int(now[dst].sum())) > 0:
                donors = [c for c in range(len(now)) if c != dst and now[c].sum() > least_units]
                if not donors:
                    break
                src = max(donors, key=lambda c: (now[c].sum(), -c))
                group = int(now[src].argmax())
                move(src, group, dst, int(max(1, min(short, now[src].sum() - least_units, now[src, group] - 1))))
                changed = True
        if not changed:
            break
    unmet = [{"client": c, "units": int(now[c].sum()), "groups": int((now[c] > 0).sum())} for c in range(len(now)) if now[c].sum() < least_units or (now[c] > 0).sum() < least_groups]
    return [(*key, k) for key, k in moves.items()], unmet


def apply_moves(df: DataFrame, moves: list[tuple[int, int, int, int]], groups: list[str], seed: int = 0, group: str = "label", id_col: str = "id") -> DataFrame:
    """Reassigns, for each planned move, the next rows of ``(src, group)`` by uniform."""
    used: dict[tuple[int, int], int] = {}
    rows = []
    for src, g, dst, k in moves:
        at = used.get((src, g), 0)
        rows.append((src, groups[g], dst, at, at + k))
        used[src, g] = at + k
    plan = F.broadcast(df.sparkSession.createDataFrame(rows, f"client int, {group} string, dst int, lo long, hi long"))
    ranked = exact_rank(df.withColumn("_u", u(seed, "repair", id_col)), ["client", group], "_u", [id_col]).drop("_u")
    hit = ranked.alias("r").join(plan.alias("p"), (F.col("r.client") == F.col("p.client")) & (F.col(f"r.{group}") == F.col(f"p.{group}")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left")
    keep = [F.col(f"r.{c}") for c in df.columns if c != "client"]
    return hit.select(*keep, F.coalesce("dst", F.col("r.client")).alias("client"))


#: Sampler registry: name -> function of (df, labels, clients, options).
SAMPLERS: dict[str, Callable[..., DataFrame]] = {
    "uniform": lambda df, labels, clients, **o: uniform_sampling(df, clients, o.get("sample_num", 0), o.get("seed", 0)),
    "iid": lambda df, labels, clients, **o: iid_sampling(df, clients, o.get("sample_num", 0), o.get("seed", 0)),
    "pathological": lambda df, labels, clients, **o: pathological_sampling(df, labels, clients, o["alpha"], o.get("sample_num", 0), o.get("seed", 0)),
    "dirichlet": lambda df, labels, clients, **o: dirichlet_sampling(df, labels, clients, o["alpha"], o.get("sample_num", 0), o.get("seed", 0)),
}


def sample(name: str, df: DataFrame, labels: list[str], clients: int, **options) -> DataFrame:
    if name not in SAMPLERS:
        raise ValueError(f"unknown sampler {name!r}; known: {', '.join(sorted(SAMPLERS))}")
    return SAMPLERS[name](df, labels, clients, **options)


# Samplers by domain: every domain has its own clients and is sampled by itself.

SEPARATOR = "\x1f"  # between the parts of a key


def domain_sampling(name: str, df: DataFrame, domains: list[str], clients: int, labels: list[str], sample_num: int = 0, alpha: float = 1, seed: int = 0, test: bool = False, id_col: str = "id") -> DataFrame:
    """``client, domain, label, id``: a sampler of the registry within each domain, all in one plan.

    Domain g has the clients ``g * clients`` to ``g * clients + clients - 1``; keys of the draws
    are (domain, label).  With ``test`` a domain is sampled once, as many rows as it has, and
    all its clients share these rows.  Rows of other domains are left out.
    """
    if name not in SAMPLERS:
        raise ValueError(f"unknown sampler {name!r}; known: {', '.join(sorted(SAMPLERS))}")
    spark, each = df.sparkSession, 1 if test else clients
    own = df.select(id_col, "domain", "label").filter(F.col("domain").isin(domains))
    sizes = label_counts(own, "domain")
    number = {d: g for g, d in enumerate(domains)}
    part = {d: sizes.get(d, 0) if test else sample_num or sizes.get(d, 0) // each for d in domains}
    if name == "uniform":
        small = [d for d in domains if each * part[d] > sizes.get(d, 0)]
        if small:
            raise ValueError(f"domains with too few rows: {', '.join(small)}")
        plan = spark.createDataFrame([(d, number[d] * each, max(1, sizes.get(d, 0) // each), part[d]) for d in domains], "domain string, base int, stretch long, take long")
        ranked = exact_rank(own.withColumn("_u", u(seed, "domain", id_col)), ["domain"], "_u", [id_col]).join(F.broadcast(plan), "domain")
        nth = F.expr("rank div stretch").cast("int")
        drawn = ranked.filter((nth < each) & F.expr("rank % stretch < take")).select((F.col("base") + nth).alias("client"), "domain", "label", id_col)
    else:
        key = lambda d, label: f"{d}{SEPARATOR}{label}"
        rows = []
        for d, g in number.items():
            own_clients = range(g * each, (g + 1) * each)
            if name == "iid":
                rows += [(c, d, min(part[d], sizes.get(d, 0))) for c in own_clients]
            elif name == "dirichlet":
                mixes = client_mixes(labels, each, alpha, seed + g)
                rows += [(g * each + c, key(d, label), k) for c, label, k in dirichlet_quotas(mixes, labels, part[d])]
            else:
                rows += [(c, key(d, label), part[d] // int(alpha)) for c in own_clients for label in labels]
        wanted = spark.createDataFrame(rows, "client int, _key string, k long")
        if name == "pathological":
            chosen = chosen_classes(spark, labels, each * len(domains), int(alpha), seed)
            wanted = wanted.join(F.broadcast(chosen), (wanted["client"] == chosen["client"]) & F.endswith("_key", F.concat(F.lit(SEPARATOR), "label")), "left_semi")
        keyed = own.withColumn("_key", F.col("domain") if name == "iid" else F.concat("domain", F.lit(SEPARATOR), "label"))
        drawn = draw(keyed.select(id_col, "_key"), wanted, seed, "domain", "_key", id_col).select("client", id_col).join(own, id_col).select("client", "domain", "label", id_col)
    if not test:
        return drawn
    shared = F.explode(F.sequence(F.col("client") * clients, F.col("client") * clients + (clients - 1)))
    return drawn.select(shared.alias("client"), "domain", "label", id_col)
