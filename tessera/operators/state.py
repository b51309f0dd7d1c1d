"""Model-state tables: one row per (round, client, key, pos) with a value.

Server rules are aggregations over clients, or recurrences over the (tens of)
rounds of one (key, pos), folded in an ordered array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.order import rank
from ..functions.rng import u

CELL = ["key", "pos"]


def weighted_average(state: DataFrame, keys: list[str], value: str = "value", weight: str = "sample_num") -> DataFrame:
    """Sample-weighted mean per ``keys``; partial sums are made map-side."""
    return state.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value))


def uplink_cost(state: DataFrame, rule: str, all_clients: int) -> DataFrame:
    """One row ``bytes``, by the formula of each rule (kept as they are defined)."""
    numel = F.countDistinct("key", "pos")
    clients = F.countDistinct("client")
    forms = {"average": 4 * clients * numel, "critical": 4 * clients * numel + clients * numel, "control": F.lit(4 * all_clients * 2) * numel}
    return state.agg(forms[rule].cast("long").alias("bytes"))


def traffic(rounds: DataFrame, clients: str = "clients", params: str = "params") -> DataFrame:
    """Adds bytes of each round (2 ways, 2 bytes a parameter), their running
    total, and that total as text."""
    each = (2 * F.col(clients) * F.col(params) * 2).cast("long")
    total = F.sum("bytes").over(W.partitionBy(F.lit(0)).orderBy("round").rowsBetween(W.unboundedPreceding, 0))
    out = rounds.withColumn("bytes", each).withColumn("total", total)
    unit = lambda n, name: F.concat(F.format_string("%.2f", F.col("total") / n), F.lit(" " + name))
    return out.withColumn("text", F.when(F.col("total") >= 2**30, unit(float(2**30), "GB")).when(F.col("total") >= 2**20, unit(float(2**20), "MB")).otherwise(unit(1024.0, "KB")))


def deltas(state: DataFrame, weighted: bool = True) -> DataFrame:
    """``round, key, pos, d``: what the clients' values change against the
    average of the round before (zero before the first)."""
    mean = weighted_average(state, ["round", *CELL]) if weighted else state.groupBy("round", *CELL).agg(F.avg("value").alias("value"))
    before = F.coalesce(F.lag("value").over(W.partitionBy(*CELL).orderBy("round")), F.lit(0.0))
    return mean.withColumn("d", F.col("value") - before).select("round", *CELL, "d")


def server_rule(changes: DataFrame, rule: str, lr: float = 0.1, beta1: float = 0.9, beta2: float = 0.99, tau: float = 1e-3) -> DataFrame:
    """``key, pos, w`` after all rounds of ``changes`` (round, key, pos, d).

    momentum, adagrad, yogi, adam: a fold over the ordered rounds that carries
    ``w, m, v``; the first momentum is the first change, ``v`` starts at tau²."""
    series = changes.groupBy(*CELL).agg(F.transform(F.array_sort(F.collect_list(F.struct("round", "d"))), lambda x: x["d"]).alias("ds"))
    start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("m"), F.lit(tau**2).alias("v"), F.lit(False).alias("on"))

    def step(s: Column, d: Column) -> Column:
        m = F.when(s["on"], beta1 * s["m"] + (1 - beta1) * d).otherwise(d)
        if rule == "momentum":
            return F.struct((s["w"] + m).alias("w"), m.alias("m"), s["v"].alias("v"), F.lit(True).alias("on"))
        if rule == "adagrad":
            v = s["v"] + d * d
            move = lr * d / (F.sqrt(v) + tau)
        elif rule == "yogi":
            v = s["v"] - (1 - beta2) * m * m * F.signum(s["v"] - m * m)
            move = lr * m / (F.sqrt(v) + tau)
        elif rule == "adam":
            v = beta2 * s["v"] + (1 - beta2) * m * m
            move = lr * m / (F.sqrt(v) + tau)
        else:
            raise ValueError(f"unknown server rule {rule!r}")
        return F.struct((s["w"] + move).alias("w"), m.alias("m"), v.alias("v"), F.lit(True).alias("on"))

    return series.select(*CELL, F.aggregate("ds", start, step, lambda s: s["w"]).alias("w"))


def pick_rule(name: str) -> str:
    """The server rule a method name asks for: the first of these it contains."""
    for part, rule in (("scaffold", "scaffold"), ("fedavgm", "momentum"), ("fedadagrad", "adagrad"), ("fedyogi", "yogi"), ("fedadam", "adam"), ("fednova", "nova")):
        if part in name.lower():
            return rule
    return "average"


def local_steps(clients: DataFrame, names: tuple[str, ...] = ("tau_eff", "normalizer", "tau", "local_steps"), eps: float = 1e-12) -> DataFrame:
    """Adds ``tau``: the first of ``names`` that exists and is not null, at least
    ``eps``; 1 where all are null."""
    have = [F.col(n).cast("double") for n in names if n in clients.columns]
    return clients.withColumn("tau_c", F.greatest(F.coalesce(*have, F.lit(1.0)), F.lit(eps)))


def normalised_average(state: DataFrame, before: DataFrame, clients: DataFrame, lr: float = 1.0) -> DataFrame:
    """``key, pos, w``: w + lr * tau_eff * sum p (w_c - w) / tau_c."""
    total = clients.agg(F.sum("sample_num").alias("n"))
    p = F.broadcast(clients.join(total).select("client", "tau_c", (F.col("sample_num") / F.col("n")).alias("p")))
    tau = F.broadcast(p.agg(F.sum(F.col("p") * F.col("tau_c")).alias("tau_eff")))
    moved = state.join(p, "client").join(before, CELL).groupBy(*CELL).agg(F.sum(F.col("p") * (F.col("value") - F.col("w")) / F.col("tau_c")).alias("s"), F.max("w").alias("w"))
    return moved.join(tau).select(*CELL, (F.col("w") + lr * F.col("tau_eff") * F.col("s")).alias("w"))


def control_server(changes: DataFrame, before: DataFrame, all_clients: int, lr: float = 1.0, weighted: bool = True) -> DataFrame:
    """``key, pos, w, c``: changes are ``client, sample_num, key, pos, dy, dc``.

    Weighted: w gets the sample-weighted change.  Mean: w gets the plain mean
    of dy and c gets K/N times the mean of dc, which is the same sum over N."""
    dy = F.sum(F.col("sample_num") * F.col("dy")) / F.sum("sample_num") if weighted else F.avg("dy")
    s = changes.groupBy(*CELL).agg(dy.alias("dy"), F.sum("dc").alias("dc"))
    return before.join(s, CELL, "left").select(*CELL, (F.col("w") + lr * F.coalesce("dy", F.lit(0.0))).alias("w"), (F.col("c") + F.coalesce("dc", F.lit(0.0)) / all_clients).alias("c"))


def client_control(rows: DataFrame, steps: float, lr: float, eps: float = 1e-12) -> DataFrame:
    """Adds ``c_new`` and ``dc`` to rows ``ci, c, w_before, w_after``: a cell
    that lacks either weight keeps its control variate."""
    new = F.col("ci") - F.col("c") + (F.col("w_before") - F.col("w_after")) / (max(1.0, steps) * max(eps, lr))
    out = rows.withColumn("c_new", F.when(F.col("w_before").isNotNull() & F.col("w_after").isNotNull(), new).otherwise(F.col("ci")))
    return out.withColumn("dc", F.col("c_new") - F.col("ci"))


def critical_mask(rows: DataFrame, share: float) -> DataFrame:
    """Adds ``mask`` to ``client, key, pos, w, d``: whether ``|d * w|`` is among
    the ``int(share * n)`` largest of its (client, key); where that threshold
    is at most 1e-10, it is the smallest score above 1e-20."""
    own = rows.withColumn("score", F.abs(F.col("d") * F.col("w")))
    keys = ["client", "key"]
    # The ranked rows are written once, and scores and thresholds both come from there: sums of
    # floats that are computed again may differ in their last bits, and a cell from its own score.
    ranked = rank(own, keys, [F.desc("score"), F.col("pos")])
    sizes = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("score") > 1e-20, F.col("score"))).alias("least"))
    placed = ranked.join(F.broadcast(sizes), keys)
    kth = placed.filter(F.col("rank") == F.greatest(F.floor(F.col("n") * share), F.lit(1)) - 1).select(*keys, F.col("score").alias("at"))
    cut = F.when(F.col("at") <= 1e-10, F.coalesce("least", F.lit(float("inf")))).otherwise(F.col("at"))
    marked = placed.join(F.broadcast(kth), keys).withColumn("mask", F.col("score") >= cut)
    return marked.select(*rows.columns, "score", "mask")


def packed_masks(masks: DataFrame, words: int = 64) -> DataFrame:
    """``key, chunk, clients``: for each 64 * ``words`` places of a key an array of ``client, held,
    known, mask``: the places that the client has, those whose mask is not null, and those with
    its mask set, as bits of longs."""
    bit = lambda c: F.bit_or(F.when(c, F.expr("shiftleft(1L, cast(pos % 64 as int))")).otherwise(F.lit(0).cast("long")))
    word = masks.groupBy("key", "client", F.expr("pos div 64").alias("word")).agg(bit(F.lit(True)).alias("held"), bit(F.col("mask").isNotNull()).alias("known"), bit(F.col("mask").cast("boolean")).alias("mask"))
    chunk = word.groupBy("key", "client", F.expr(f"word div {words}").alias("chunk")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("word") % words).cast("int"), F.struct("held", "known", "mask")))).alias("m"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda k: F.try_element_at("m", k))
    full = lambda name: F.transform("slots", lambda x: F.coalesce(x[name], F.lit(0).cast("long")))
    own = chunk.withColumn("slots", slots).select("key", "chunk", F.struct("client", *[full(n).alias(n) for n in ("held", "known", "mask")]).alias("c"))
    return own.groupBy("key", "chunk").agg(F.collect_list("c").alias("clients"))


def client_pairs(masks: DataFrame) -> DataFrame:
    """``i, j, cells, known, differ, ones`` of each ordered pair of clients: the cells that both
    have, those where neither mask is null, those where the masks differ (a null neither differs
    nor agrees), and those where that of ``i`` is set.

    Masks travel as bits, 64 cells a long, and a chunk of them gives one row a pair, summed
    before it is shuffled."""
    total = lambda e: f"aggregate(transform(sequence(0, size(a.held) - 1), k -> bit_count({e})), 0L, (s, x) -> s + x)"
    both, known = "a.held[k] & b.held[k]", "a.known[k] & b.known[k]"
    counts = {"cells": both, "known": known, "differ": f"(a.mask[k] ^ b.mask[k]) & {known}", "ones": f"a.mask[k] & {both}"}
    pair = "named_struct('i', a.client, 'j', b.client, " + ", ".join(f"'{name}', {total(e)}" for name, e in counts.items()) + ")"
    pairs = packed_masks(masks).select(F.explode(F.expr(f"flatten(transform(clients, a -> transform(filter(clients, b -> b.client <> a.client), b -> {pair})))")).alias("p")).select("p.*")
    return pairs.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in counts]).filter("cells > 0")


def mask_overlap(masks: DataFrame) -> DataFrame:
    """``i, j, overlap`` of each ordered pair of clients: 1 - sum|m_i - m_j| / (2 sum m_i), as
    floats divide: minus infinity or NaN where ``i`` has no mask set; null where no cell has both
    masks."""
    by_zero = F.when(F.col("differ") > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    away = F.when(F.col("ones") > 0, F.col("differ") / F.when(F.col("ones") > 0, 2 * F.col("ones"))).otherwise(by_zero)
    return client_pairs(masks).select("i", "j", F.when(F.col("known") > 0, 1 - away).alias("overlap"))


def collaborators(overlap: DataFrame, epoch: int, beta: float) -> DataFrame:
    """``i, j`` of the pairs at or above avg + (epoch + 1) / beta * (max - avg)."""
    t = overlap.agg(F.avg("overlap").alias("mean"), F.max("overlap").alias("top"))
    cut = F.col("mean") + (epoch + 1) / beta * (F.col("top") - F.col("mean"))
    return overlap.join(F.broadcast(t)).filter(F.col("overlap") >= cut - 1e-12).select("i", "j")


def customised(state: DataFrame, pairs: DataFrame) -> DataFrame:
    """``client, key, pos, custom``: the mean of a client and its collaborators over the values
    that are not null (null if there is none) of the cells that any of them has.

    The clients' values of a cell meet once, and the table of collaborators (clients x clients
    at most) says which of them count for whom."""
    selves = state.select("client").distinct().select(F.col("client").alias("i"), F.col("client").alias("j"))
    with_ = pairs.select("i", "j").unionByName(selves).distinct().groupBy("i").agg(F.collect_list("j").alias("js"))
    circles = with_.agg(F.collect_list(F.struct("i", "js")).alias("circles"))
    cells = state.groupBy(*CELL).agg(F.collect_list(F.struct("client", "value")).alias("held")).join(F.broadcast(circles))
    own = "array_contains(c.js, h.client)"
    mean = f"transform(array(filter(held, h -> {own} and h.value is not null)), g -> if(size(g) = 0, null, aggregate(g, 0D, (a, h) -> a + h.value) / size(g)))[0]"
    each = cells.select(*CELL, F.explode(F.expr(f"transform(filter(circles, c -> exists(held, h -> {own})), c -> named_struct('client', c.i, 'custom', {mean}))")).alias("c"))
    return each.select("c.client", *CELL, "c.custom")


def masked_merge(masks: DataFrame, custom: DataFrame, global_: DataFrame) -> DataFrame:
    """Critical cells from the customised average, the others from the global one."""
    both = masks.select("client", *CELL, "mask").join(custom, ["client", *CELL]).join(global_.select(*CELL, F.col("value").alias("shared")), CELL)
    return both.select("client", *CELL, F.when(F.col("mask"), F.col("custom")).otherwise(F.col("shared")).alias("value"))


def summary(state: DataFrame, *by: str) -> DataFrame:
    return state.groupBy(*by).agg(F.countDistinct("key").alias("tensors"), F.count(F.lit(1)).alias("params"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("l2"))


def difference(a: DataFrame, b: DataFrame, p: float = 2.0) -> DataFrame:
    """One row: L2 over shared cells, and the p-norms by key, non-finite ones left out, summed."""
    d = a.select(*CELL, F.col("value").alias("x")).join(b.select(*CELL, F.col("value").alias("y")), CELL).withColumn("d", F.col("x") - F.col("y"))
    by_key = d.groupBy("key").agg(F.sum(F.col("d") * F.col("d")).alias("s2"), F.pow(F.sum(F.pow(F.abs("d"), p)), 1 / p).alias("norm"))
    ok = ~F.isnan("norm") & (F.abs("norm") < float("inf"))
    return by_key.agg(F.sqrt(F.sum("s2")).alias("l2"), F.sum(F.when(ok, F.col("norm"))).alias("norms"))


def arithmetic(a: DataFrame, b: DataFrame, scale: float) -> DataFrame:
    both = a.select(*CELL, F.col("value").alias("x")).join(b.select(*CELL, F.col("value").alias("y")), CELL)
    return both.select(*CELL, (F.col("x") + F.col("y")).alias("added"), (F.col("x") - F.col("y")).alias("taken"), (F.col("x") * scale).alias("scaled"))


def prefix_audit(state: DataFrame, depth: int) -> DataFrame:
    return state.groupBy(F.substring_index("key", ".", depth).alias("prefix")).agg(F.count(F.lit(1)).alias("params"))


def keyword_audit(state: DataFrame, keywords: list[str]) -> DataFrame:
    """Parameters whose name contains each keyword; a name may count for several."""
    words = F.broadcast(state.sparkSession.createDataFrame([(k,) for k in keywords], "keyword string"))
    names = state.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return words.join(names, F.col("key").contains(F.col("keyword")), "left").groupBy("keyword").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("params"))


def watched(state: DataFrame, key: str, *by: str) -> DataFrame:
    return state.filter(F.col("key") == key).groupBy(*by).agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"))


def vector_distances(pairs: DataFrame) -> DataFrame:
    """``id, l2sq, cosine_distance, psnr`` of rows ``id, pos, x, y``."""
    s = lambda e: F.sum(e)
    d2 = s((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))
    cos = s(F.col("x") * F.col("y")) / F.sqrt(s(F.col("x") * F.col("x")) * s(F.col("y") * F.col("y")))
    return pairs.groupBy("id").agg(d2.alias("l2sq"), (1 - cos).alias("cosine_distance"), F.when(d2 > 0, -10 * F.log10(d2 / F.count(F.lit(1)))).alias("psnr"))


def resumed(global_: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Global cells, overridden by the checkpoint's where it has them."""
    saved = checkpoint.select(*CELL, F.col("value").alias("_saved"))
    return global_.join(saved, CELL, "left").select(*CELL, F.coalesce("_saved", "value").alias("value"))


def select_parameters(state: DataFrame, how: str = "all", keywords: list[str] | None = None) -> DataFrame:
    """``all``, those that ``contain`` any keyword, or all ``except`` those."""
    hit = F.lit(False)
    for k in keywords or []:
        hit = hit | F.col("key").contains(k)
    return {"all": lambda: state, "contain": lambda: state.filter(hit), "except": lambda: state.filter(~hit)}[how]()


def rotating_selection(state: DataFrame, sets: list[list[str]], every: int = 2) -> DataFrame:
    """The keyword set changes every ``every`` rounds, in turn."""
    table = F.broadcast(state.sparkSession.createDataFrame([(i, k) for i, s in enumerate(sets) for k in s], "idx int, keyword string"))
    idx = F.pmod(F.floor(F.col("round") / every), F.lit(len(sets))).cast("int")
    return state.withColumn("idx", idx).join(table, "idx").filter(F.col("key").contains(F.col("keyword"))).drop("idx", "keyword").dropDuplicates()


def bootstrap_mean(rows: DataFrame, value: str, draws: int, id_col: str, seed: int = 0) -> DataFrame:
    """Median over ``draws`` Poisson-weighted resamples of the mean."""
    x = u(seed, "poisson", "b", id_col)
    cdf, weight, p = 0.0, F.lit(0), 0.36787944117144233
    for k in range(8):
        cdf += p
        weight = weight + (x >= cdf).cast("int")
        p /= k + 1
    runs = rows.select(id_col, value, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b")).withColumn("w", weight)
    means = runs.groupBy("b").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("m"))
    return means.agg(F.percentile("m", 0.5).alias("mid"))
