"""Queries of the split, window and modality operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rng import ROUNDS, exact_rank, u
from ..operators import modality, split
from .views import ASSIGNED, CLIENTS, IDS, LABELS, QA, SAMPLES, SEED, SHARES, UNITS, assigned, ids, query, questions, samples, sql_assigned, sql_u, units, values

RANKED = "row_number() OVER (PARTITION BY {keys} ORDER BY {u}, id) - 1"


@query("s01_uniform", f"""WITH {IDS}, r AS (SELECT *, row_number() OVER (ORDER BY {sql_u(SEED, 'uniform', 'id')}, id) - 1 AS rank, count(*) OVER () // 10 AS each FROM ids)
    SELECT id, label, (rank // each)::INT AS client FROM r WHERE rank // each < 10 AND rank % each < 20""")
def _(spark, d):
    return split.uniform_sampling(ids(spark, d).drop("domain"), 10, 20, SEED).select("id", "label", "client")


def sql_draw(wanted: str, salt: str, source: str = "ids", key: str = "label", seed: int = SEED) -> str:
    """``split.draw`` of a CTE ``wanted(client, label, k)`` from the ids of ``source``."""
    steps = [f"""{salt}_0 AS (SELECT a.client, a.label, a.k, a.pool, n.nth, n.nth AS x FROM
        (SELECT w.client, w.label, w.k, s.pool FROM {wanted} w JOIN (SELECT DISTINCT label, pool FROM {salt}_pool) s ON w.label = s.label WHERE w.k > 0) a, LATERAL (SELECT unnest(range(0, a.k::BIGINT)) AS nth) n)"""]
    for i in range(ROUNDS):
        swap = f"substr(md5(concat_ws('::', '{seed}', '{salt}-swap', client::VARCHAR, label, '{i}', greatest(x, o)::VARCHAR)), 1, 1) < '8'"
        other = f"(floor({sql_u(seed, f'{salt}-key{i}', 'client', 'label')} * pool)::BIGINT - x + pool) % pool"
        steps.append(f"{salt}_{i + 1} AS (SELECT client, label, k, pool, nth, CASE WHEN {swap} THEN o ELSE x END AS x FROM (SELECT *, {other} AS o FROM {salt}_{i}))")
    pool = f"{salt}_pool AS (SELECT id, {key} AS label, {RANKED.format(keys=key, u=sql_u(seed, salt, 'id'))} AS idx, count(*) OVER (PARTITION BY {key}) AS pool FROM {source})"
    place = f"CASE WHEN k <= pool THEN x ELSE floor({sql_u(seed, salt + '-with', 'client', 'label', 'nth')} * pool)::BIGINT END"
    return f"{pool}, {', '.join(steps)}, {salt}_places AS (SELECT client, label, {place} AS idx FROM {salt}_{ROUNDS}), {salt}_drawn AS (SELECT p.client, p.label, o.id FROM {salt}_places p JOIN {salt}_pool o ON o.label = p.label AND o.idx = p.idx)"


def sql_iid(clients: int, k: str, seed: int) -> str:
    wanted = f"iid_wanted AS (SELECT range::INT AS client, '' AS label, {k} AS k FROM range({clients}))"
    return f"{wanted}, {sql_draw('iid_wanted', 'iid', key=chr(39) * 2, seed=seed)}"


@query("s02_iid_overlap", f"WITH {IDS}, {sql_iid(10, '30', SEED)} SELECT d.client, i.id, i.label FROM iid_drawn d JOIN ids i USING (id)")
def _(spark, d):
    return split.iid_sampling(ids(spark, d).drop("domain"), 10, 30, SEED).select("client", "id", "label")


CLASSES = f"""classes AS (SELECT client, label FROM (SELECT c.client, l.label, row_number() OVER (PARTITION BY c.client ORDER BY {sql_u(SEED, 'classes', 'c.client', 'l.label')}, l.label) AS r
    FROM (SELECT range::INT AS client FROM range(10)) c CROSS JOIN (SELECT unnest({LABELS!r}) AS label) l) WHERE r <= 2)"""


@query("s03_pathological", f"WITH {IDS}, {CLASSES}, wanted AS (SELECT client, label, 20 AS k FROM classes), {sql_draw('wanted', 'patho')} SELECT * FROM patho_drawn")
def _(spark, d):
    return split.pathological_sampling(ids(spark, d), LABELS, 10, 2, 40, SEED)


MIXED = split.dirichlet_quotas(split.client_mixes(LABELS, 10, 0.5, SEED), LABELS, 60)


@query("s04_dirichlet_overlap", f"WITH {IDS}, {values('wanted', 'client, label, k', MIXED)}, {sql_draw('wanted', 'dirov')} SELECT * FROM dirov_drawn")
def _(spark, d):
    return split.dirichlet_sampling(ids(spark, d), LABELS, 10, 0.5, 60, SEED)


LARGE = [(c, label, 700) for c in range(3) for label in LABELS]


@query("s05_draw_with_replacement", f"WITH {IDS}, {values('wanted', 'client, label, k', LARGE)}, {sql_draw('wanted', 'draw')} SELECT * FROM draw_drawn")
def _(spark, d):
    return split.draw(ids(spark, d), spark.createDataFrame(LARGE, "client int, label string, k long"), SEED)


@query("s06_round_robin", f"""WITH {IDS}, r AS (SELECT id, label, {RANKED.format(keys='label', u=sql_u(SEED, 'strat', 'id'))} AS rank, dense_rank() OVER (ORDER BY label) - 1 AS l FROM ids)
    SELECT id, label, ((rank + l) % 10)::INT AS client FROM r""")
def _(spark, d):
    return split.stratified_round_robin(ids(spark, d), 10, SEED).select("id", "label", "client")


@query("s07_dirichlet_exact", f"WITH {ASSIGNED} SELECT id, label, client FROM assigned")
def _(spark, d):
    return assigned(spark, d).select("id", "label", "client")


#: Consecutive shares of a label's rows, in thousandths of the label's size.
PARTS = [(label, c, lo, hi) for label, c, lo, hi in split.bounds(SHARES)]


@query("s07b_dirichlet_quota", f"""WITH {IDS}, {values('cuts', 'label, client, lo, hi', PARTS)},
    r AS (SELECT id, label, {RANKED.format(keys='label', u=sql_u(SEED, 'quota', 'id'))} AS rank, count(*) OVER (PARTITION BY label) AS n FROM ids)
    SELECT id, r.label, client FROM r JOIN cuts c ON c.label = r.label AND rank >= floor(c.lo * n) AND rank < floor(c.hi * n)""")
def _(spark, d):
    own = ids(spark, d)
    counts = split.label_counts(own)
    quotas = [(label, c, int(lo * counts.get(label, 0)), int(hi * counts.get(label, 0))) for label, c, lo, hi in PARTS]
    return split.quota_assign(own, quotas, SEED).select("id", "label", "client")


@query("s08_retry_with_floor")
def _(spark, d):
    own = ids(spark, d)
    quotas = split.retried_quotas(split.label_counts(own), 10, 0.1, SEED)
    return split.quota_assign(own, quotas, SEED, "retry").select("id", "label", "client")


@query("s09_small_client_repair")
def _(spark, d):
    own = split.dirichlet_assign(ids(spark, d), split.dirichlet_shares(LABELS, 10, 0.1, SEED), SEED)
    matrix = split.count_matrix(own, 10, LABELS)
    moves = split.small_client_plan(matrix, split.smallest_allowed(int(matrix.sum()), 10))
    return split.apply_moves(own, moves, LABELS, SEED).select("id", "label", "client")


@query("s10_empty_client_repair")
def _(spark, d):
    # Clients 2 and 5 are empty: the next client holds their rows.
    own = split.dirichlet_assign(ids(spark, d), SHARES, SEED).withColumn("client", F.col("client") + F.col("client").isin(2, 5).cast("int"))
    moves = split.empty_client_plan(split.count_matrix(own, 10, LABELS), LABELS)
    return split.apply_moves(own, moves, LABELS, SEED).select("id", "label", "client")


DOMINANT = """tops AS (SELECT unit, grp FROM (SELECT unit, grp, row_number() OVER (PARTITION BY unit ORDER BY count(*) DESC, grp) AS r FROM units GROUP BY unit, grp) WHERE r = 1),
    dominant AS (SELECT c_custkey AS unit, coalesce(grp, '__no_instance__') AS grp FROM customer LEFT JOIN tops ON unit = c_custkey)"""


def dominant(spark, d):
    from .views import table

    return split.dominant_group(units(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("unit")))


@query("s11_dominant_group", f"WITH {UNITS}, {DOMINANT} SELECT * FROM dominant")
def _(spark, d):
    return dominant(spark, d)


GROUPS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "__no_instance__"]
UNIT_SHARES = split.dirichlet_shares(GROUPS, CLIENTS, 0.5, SEED)


@query("s12_unit_dirichlet", f"""WITH {UNITS}, {QA}, {DOMINANT}, labelled AS (SELECT unit AS id, grp AS label FROM dominant), {sql_assigned('labelled', 'placed', UNIT_SHARES)}
    SELECT q.question_id, q.image_id, p.client FROM questions q JOIN placed p ON p.id = q.image_id""")
def _(spark, d):
    own = dominant(spark, d).select(F.col("unit").alias("id"), F.col("grp").alias("label"))
    placed = split.dirichlet_assign(own, UNIT_SHARES, SEED).select(F.col("id").alias("image_id"), "client")
    return placed.join(questions(spark, d), "image_id").select("question_id", "image_id", "client")


@query("s13_constraint_repair")
def _(spark, d):
    own = dominant(spark, d).select(F.col("unit").alias("id"), F.col("grp").alias("label"))
    placed = split.dirichlet_assign(own, split.dirichlet_shares(GROUPS, CLIENTS, 0.1, SEED), SEED)
    matrix = split.count_matrix(placed, CLIENTS, GROUPS)
    moves, _unmet = split.constraint_plan(matrix, 3, int(matrix.sum()) // (2 * CLIENTS))
    return split.apply_moves(placed, moves, GROUPS, SEED).select("id", "label", "client")


@query("s14_derived_seeds", f"WITH {IDS} SELECT id, {sql_u(SEED, 'alpha=0.1::3', 'id')} AS a, {sql_u(SEED, 'alpha=0.5::3', 'id')} AS b FROM ids")
def _(spark, d):
    return ids(spark, d).select("id", u(SEED, "alpha=0.1::3", "id").alias("a"), u(SEED, "alpha=0.5::3", "id").alias("b"))


PARTS_SQL = f"""part AS (SELECT round, client FROM (SELECT r.round, c.client, row_number() OVER (PARTITION BY r.round ORDER BY {sql_u(SEED, 'part', 'r.round', 'c.client')}, c.client) AS k
    FROM (SELECT range::INT AS round FROM range(24)) r CROSS JOIN (SELECT range::INT AS client FROM range(10)) c) WHERE k <= 3)"""


@query("s15_participation", f"""WITH {PARTS_SQL} SELECT p.round, p.client, count(e.event_id) AS events FROM part p LEFT JOIN events e ON hour(e.ts) = p.round AND e.user_id % 10 = p.client GROUP BY ALL""")
def _(spark, d):
    from .views import trace

    part = split.participation(spark, 24, 10, rate=0.3, seed=SEED)
    n = trace(spark, d).groupBy("round", "client").agg(F.count(F.lit(1)).alias("events"))
    return part.join(n, ["round", "client"], "left").select("round", "client", F.coalesce("events", F.lit(0)).alias("events"))


@query("s16_evaluation_subset", f"WITH {IDS} SELECT id, label FROM ids ORDER BY {sql_u(SEED, 'eval', 'id')}, id LIMIT 100")
def _(spark, d):
    return split.evaluation_subset(ids(spark, d).select("id", "label"), 100, SEED)


@query("s17_cycling_window", f"""WITH p AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders),
    a AS (SELECT range::INT AS round, unnest(range(range * 400, range * 400 + 401)) AS at FROM range(12)) SELECT a.round, p.pos, p.id FROM a JOIN p ON p.pos = a.at % p.n""")
def _(spark, d):
    from .views import table

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    ends = o.agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    placed = o.join(F.broadcast(ends)).withColumn("_o", (F.col("id") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1))
    numbered = exact_rank(placed, [], "_o", ["id"], "pos").select("id", "pos")
    return split.cycling_window(numbered, 12, 400).select("round", "pos", "id")


DOMAINS = [f"src{i}" for i in range(20)]
EACH = 3
DOMAIN_SQL = f"{values('domains', 'domain, g', [(x, g) for g, x in enumerate(DOMAINS)])}, sized AS (SELECT domain, g, count(id) AS n FROM domains LEFT JOIN ids USING (domain) GROUP BY ALL)"
DOMAIN_MIXES = [(g * EACH + c, x, label, float(q)) for g, x in enumerate(DOMAINS) for c, own in split.client_mixes(LABELS, EACH, 0.5, SEED + g).items() for label, q in zip(LABELS, own)]
#: Quotas of a client label by label: rounded shares of what is left, the last label takes the rest.
DOMAIN_QUOTAS = f"""{values('mixes', 'client, domain, label, q', DOMAIN_MIXES)}, shares_ AS (SELECT client, m.domain, n // {EACH} AS each, max(q) FILTER (WHERE label = 'de') AS q0, max(q) FILTER (WHERE label = 'en') AS q1, max(q) FILTER (WHERE label = 'es') AS q2 FROM mixes m JOIN sized s ON s.domain = m.domain GROUP BY ALL),
    a0 AS (SELECT *, least(each, floor(each * q0 + 0.5)::BIGINT) AS k0 FROM shares_), a1 AS (SELECT *, least(each - k0, floor(each * q1 + 0.5)::BIGINT) AS k1 FROM a0), a2 AS (SELECT *, least(each - k0 - k1, floor(each * q2 + 0.5)::BIGINT) AS k2 FROM a1),
    dom_wanted AS (SELECT client, domain || chr(31) || unnest({LABELS!r}) AS label, unnest([k0, k1, k2, each - k0 - k1 - k2]) AS k FROM a2)"""


@query("s18_cross_domain", f"WITH {IDS}, {DOMAIN_SQL}, {DOMAIN_QUOTAS}, {sql_draw('dom_wanted', 'domain', key='(domain || chr(31) || label)')} SELECT d.client, i.domain, i.label, i.id FROM domain_drawn d JOIN ids i USING (id)")
def _(spark, d):
    return split.domain_sampling("dirichlet", ids(spark, d), DOMAINS, EACH, LABELS, alpha=0.5, seed=SEED)


@query("s18b_domain_test_rows", f"""WITH {IDS}, {DOMAIN_SQL} SELECT (g * {EACH} + c)::INT AS client, domain, label, id FROM ids JOIN sized USING (domain) CROSS JOIN (SELECT range AS c FROM range({EACH}))""")
def _(spark, d):
    return split.domain_sampling("uniform", ids(spark, d), DOMAINS, EACH, LABELS, seed=SEED, test=True)


DOMAIN_IID = f"dom_wanted AS (SELECT (g * {EACH} + c)::INT AS client, domain AS label, n // {EACH} AS k FROM sized CROSS JOIN (SELECT range AS c FROM range({EACH})))"


@query("s18c_domain_iid", f"WITH {IDS}, {DOMAIN_SQL}, {DOMAIN_IID}, {sql_draw('dom_wanted', 'domain', key='domain')} SELECT d.client, i.domain, i.label, i.id FROM domain_drawn d JOIN ids i USING (id)")
def _(spark, d):
    return split.domain_sampling("iid", ids(spark, d), DOMAINS, EACH, LABELS, seed=SEED)


DOMAIN_CLASSES = f"""classes AS (SELECT client, label FROM (SELECT c.client, l.label, row_number() OVER (PARTITION BY c.client ORDER BY {sql_u(SEED, 'classes', 'c.client', 'l.label')}, l.label) AS r
    FROM (SELECT range::INT AS client FROM range({EACH * len(DOMAINS)})) c CROSS JOIN (SELECT unnest({LABELS!r}) AS label) l) WHERE r <= 2),
    dom_wanted AS (SELECT client, domain || chr(31) || label AS label, (n // {EACH}) // 2 AS k FROM classes JOIN sized ON g = client // {EACH})"""


@query("s18d_domain_pathological", f"WITH {IDS}, {DOMAIN_SQL}, {DOMAIN_CLASSES}, {sql_draw('dom_wanted', 'domain', key='(domain || chr(31) || label)')} SELECT d.client, i.domain, i.label, i.id FROM domain_drawn d JOIN ids i USING (id)")
def _(spark, d):
    return split.domain_sampling("pathological", ids(spark, d), DOMAINS, EACH, LABELS, alpha=2, seed=SEED)


DISPATCHED = {
    "uniform": f"u_r AS (SELECT *, row_number() OVER (ORDER BY {sql_u(7, 'uniform', 'id')}, id) - 1 AS rank, count(*) OVER () // 5 AS each FROM ids), u_out AS (SELECT (rank // each)::INT AS client, id, label FROM u_r WHERE rank // each < 5 AND rank % each < 25)",
    "iid": f"{sql_iid(5, '25', 7)}, iid_out AS (SELECT d.client, i.id, i.label FROM iid_drawn d JOIN ids i USING (id))",
    "pathological": f"""p_classes AS (SELECT client, label FROM (SELECT c.client, l.label, row_number() OVER (PARTITION BY c.client ORDER BY {sql_u(7, 'classes', 'c.client', 'l.label')}, l.label) AS r
        FROM (SELECT range::INT AS client FROM range(5)) c CROSS JOIN (SELECT unnest({LABELS!r}) AS label) l) WHERE r <= 2), p_wanted AS (SELECT client, label, 12 AS k FROM p_classes), {sql_draw('p_wanted', 'patho', seed=7)}""",
    "dirichlet": f"{values('d_wanted', 'client, label, k', split.dirichlet_quotas(split.client_mixes(LABELS, 5, 0.5, 7), LABELS, 25))}, {sql_draw('d_wanted', 'dirov', seed=7)}",
}


@query("s19_sampler_dispatch", f"""WITH {IDS}, {', '.join(DISPATCHED.values())}
    SELECT 'uniform' AS sampler, client, id, label FROM u_out UNION ALL SELECT 'iid', client, id, label FROM iid_out
    UNION ALL SELECT 'pathological', client, id, label FROM patho_drawn UNION ALL SELECT 'dirichlet', client, id, label FROM dirov_drawn""")
def _(spark, d):
    own, alpha = ids(spark, d).drop("domain"), {"pathological": 2, "dirichlet": 0.5}
    parts = [split.sample(name, own, LABELS, 5, sample_num=25, seed=7, alpha=alpha.get(name)).select(F.lit(name).alias("sampler"), "client", "id", "label") for name in DISPATCHED]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# Modalities. SQL expressions of the masks, on a CTE with id, img, text.
def sql_bernoulli(rate: float, salt: str, keep: bool = False) -> tuple[str, str]:
    op = ">=" if keep else "<"
    di, dt = f"({sql_u(SEED, salt + '-img', 'id')} {op} {rate})", f"({sql_u(SEED, salt + '-text', 'id')} {op} {rate})"
    coin = f"({sql_u(SEED, salt + '-coin', 'id')} < 0.5)"
    return f"({di} AND NOT ({dt} AND {coin}))", f"({dt} AND NOT ({di} AND NOT {coin}))"


def flags(df, *more):
    """Ids with what is left of each modality; texts are not shown whole."""
    return df.select("id", *more, F.col("img").isNotNull().alias("has_img"), F.col("text").isNotNull().alias("has_text"))


def sql_flags(di: str, dt: str, more: str = "", source: str = "samples") -> str:
    return f"SELECT id, {more} (img IS NOT NULL AND NOT {di}) AS has_img, (text IS NOT NULL AND NOT {dt}) AS has_text FROM {source}"


@query("x01_aligned", f"WITH {SAMPLES} {sql_flags('FALSE', 'FALSE', more=chr(39) + 'aligned' + chr(39) + ' AS modal, ')}")
def _(spark, d):
    return flags(samples(spark, d).withColumn("modal", F.lit("aligned")), "modal")


@query("x02_missing", f"WITH {SAMPLES} {sql_flags(*sql_bernoulli(0.3, 'missing'))}")
def _(spark, d):
    return flags(modality.bernoulli(samples(spark, d), 0.3, SEED))


@query("x03_hybrid", f"WITH {SAMPLES} {sql_flags(*sql_bernoulli(0.6, 'hybrid', keep=True))}")
def _(spark, d):
    return flags(modality.hybrid(samples(spark, d), 0.6, SEED))


SPLIT_SAMPLES = f"{SAMPLES}, {sql_assigned('samples')}"


def split_samples(spark, d):
    return split.dirichlet_assign(samples(spark, d), SHARES, SEED)


def sql_client_ranks(salt: str) -> str:
    return f"ranks AS (SELECT client, row_number() OVER (ORDER BY {sql_u(SEED, salt, 'client')}, client) AS r FROM (SELECT range::INT AS client FROM range(10)))"


@query("x04_cross", f"WITH {SPLIT_SAMPLES}, {sql_client_ranks('cross')}, j AS (SELECT a.*, r.r FROM assigned a JOIN ranks r USING (client)) {sql_flags('NOT (r <= 3)', '(r <= 3)', 'client, ', 'j')}")
def _(spark, d):
    return flags(modality.cross(split_samples(spark, d), 3, 7, 10, SEED), "client")


@query("x05_missing_exact", f"""WITH {SPLIT_SAMPLES}, e AS (SELECT *, coalesce(img IS NOT NULL AND length(trim(text)) > 0, FALSE) AS ok FROM assigned),
    r AS (SELECT *, row_number() OVER (PARTITION BY client, ok ORDER BY {sql_u(SEED, 'exact', 'id')}, id) - 1 AS r, round_even(count(*) FILTER (WHERE ok) OVER (PARTITION BY client) * 0.3, 0) AS k FROM e),
    h AS (SELECT *, ok AND r < k AS hit, {sql_u(SEED, 'which', 'id')} < 0.5 AS which FROM r) {sql_flags('(hit AND which)', '(hit AND NOT which)', 'client, ', 'h')}""")
def _(spark, d):
    return flags(modality.exact_missing(split_samples(spark, d), 0.3, "random", SEED), "client")


PATTERNS = f"{sql_client_ranks('pattern')}, patterns AS (SELECT client, CASE WHEN r <= 3 THEN 'image_only' WHEN r <= 5 THEN 'text_only' ELSE 'image_text' END AS pattern FROM ranks)"


@query("x06_client_patterns", f"WITH {ASSIGNED}, {PATTERNS} SELECT client, pattern, count(a.id) AS n FROM patterns LEFT JOIN assigned a USING (client) GROUP BY ALL")
def _(spark, d):
    n = assigned(spark, d).groupBy("client").agg(F.count(F.lit(1)).alias("n"))
    return modality.client_patterns(spark, 10, 0.5, SEED).join(n, "client", "left").select("client", "pattern", F.coalesce("n", F.lit(0)).alias("n"))


@query("x07_cross_apply", f"""WITH {SPLIT_SAMPLES}, {PATTERNS}, j AS (SELECT a.*, pattern, {sql_u(SEED, 'apply', 'id')} < 0.7 AS hit FROM assigned a JOIN patterns USING (client))
    {sql_flags("(hit AND pattern = 'text_only')", "(hit AND pattern = 'image_only')", 'client, ', 'j')}""")
def _(spark, d):
    return flags(modality.apply_patterns(split_samples(spark, d), modality.client_patterns(spark, 10, 0.5, SEED), 0.7, SEED), "client")


@query("x08_notes", f"WITH {IDS} SELECT id, ['aligned', CASE WHEN label = 'en' THEN 'kept' ELSE 'missing' END] AS transformations FROM ids")
def _(spark, d):
    own = modality.noted(ids(spark, d).withColumn("transformations", F.lit(None).cast("array<string>")), "aligned")
    return modality.noted(own.filter("label = 'en'"), "kept").unionByName(modality.noted(own.filter("label <> 'en'"), "missing")).select("id", "transformations")


MISSING = sql_bernoulli(0.3, "missing")


#: The settings of the grid, four statistical and ten modal ones.
ALPHAS = [1.0, 0.5, 0.1]
MODALS = modality.modal_settings([0.3, 0.4, 0.5], [(3, 7), (5, 5), (7, 3)], [0.8, 0.7, 0.6])


def grid(spark, d):
    """Every statistical setting with every modal one, from one scan."""
    own, placed = split.placements(samples(spark, d), LABELS, CLIENTS, ALPHAS, SEED)
    settings = modality.settings_table(spark, ["iid", *[f"dir_{a}" for a in ALPHAS]], MODALS, CLIENTS, SEED)
    return modality.setting_grid(own.select("id", "label", "img", "text", placed.alias("_p")), F.col("_p"), settings, SEED).drop("_p")


def sql_grid() -> str:
    parts, names = [], {a: f"a{str(a).replace('.', '_')}" for a in ALPHAS}
    for a, name in names.items():
        parts.append(sql_assigned("samples", name, split.dirichlet_shares(LABELS, CLIENTS, a, SEED)))
    dealt = f"""dealt AS (SELECT *, ((row_number() OVER (PARTITION BY label ORDER BY {sql_u(SEED, 'strat', 'id')}, id) - 1 + l) % {CLIENTS})::INT AS client FROM (SELECT *, dense_rank() OVER (ORDER BY label) - 1 AS l FROM samples))"""
    union = " UNION ALL ".join(["SELECT id, label, client, 'iid' AS stat, img, text FROM dealt", *[f"SELECT id, label, client, 'dir_{a}' AS stat, img, text FROM {name}" for a, name in names.items()]])
    ranks = f"row_number() OVER (PARTITION BY stat, modal ORDER BY {sql_u(SEED, 'grid-cross', 'stat', 'modal', 'client')}, client) <= image_only AS image_client"
    settings = f"settings AS (SELECT *, {ranks} FROM modals CROSS JOIN (SELECT DISTINCT stat FROM both_) CROSS JOIN (SELECT range::INT AS client FROM range({CLIENTS})))"
    hit = lambda x: f"CASE kind WHEN 'missing' THEN {sql_u(SEED, f'grid-{x}', 'b.stat', 'modal', 'id')} < rate WHEN 'hybrid' THEN {sql_u(SEED, f'grid-{x}', 'b.stat', 'modal', 'id')} >= rate ELSE FALSE END"
    marked = f"marked AS (SELECT b.*, modal, kind, image_client, {hit('img')} AS hi, {hit('text')} AS ht, {sql_u(SEED, 'grid-coin', 'b.stat', 'modal', 'id')} < 0.5 AS coin FROM both_ b JOIN settings s ON s.stat = b.stat AND s.client = b.client)"
    di, dt = "CASE WHEN kind = 'cross' THEN NOT image_client ELSE hi AND NOT (ht AND coin) END", "CASE WHEN kind = 'cross' THEN image_client ELSE ht AND NOT (hi AND NOT coin) END"
    masked = f"SELECT id, label, client, stat, modal, CASE WHEN NOT {di} THEN img END AS img, CASE WHEN NOT {dt} THEN text END AS text FROM marked"
    return f"{SAMPLES}, {values('modals', 'modal, kind, rate, image_only', MODALS)}, {', '.join(parts)}, {dealt}, both_ AS ({union}), {settings}, {marked}, grid AS ({masked})"


@query("s20_setting_grid", f"WITH {sql_grid()} SELECT stat, modal, client, count(*) AS n, count(img) AS with_img, count(text) AS with_text FROM grid GROUP BY ALL")
def _(spark, d):
    return grid(spark, d).groupBy("stat", "modal", "client").agg(F.count(F.lit(1)).alias("n"), F.count("img").alias("with_img"), F.count("text").alias("with_text"))


@query("s21_processing_grid", f"""WITH {SPLIT_SAMPLES}, {PATTERNS}, m AS (SELECT * REPLACE (CASE WHEN NOT {MISSING[0]} THEN img END AS img, CASE WHEN NOT {MISSING[1]} THEN text END AS text) FROM assigned),
    j AS (SELECT m.*, pattern, {sql_u(SEED, 'apply', 'id')} < 1.0 AS hit FROM m JOIN patterns USING (client))
    SELECT client, count(*) AS n, count(CASE WHEN pattern <> 'text_only' THEN img END) AS with_img, count(CASE WHEN pattern <> 'image_only' THEN text END) AS with_text FROM j GROUP BY ALL""")
def _(spark, d):
    missing = modality.bernoulli(split_samples(spark, d), 0.3, SEED)
    both = modality.apply_patterns(missing, modality.client_patterns(spark, 10, 0.5, SEED), 1.0, SEED)
    return both.groupBy("client").agg(F.count(F.lit(1)).alias("n"), F.count("img").alias("with_img"), F.count("text").alias("with_text"))


@query("w01_shuffled_rank", f"WITH {IDS} SELECT id, label, {RANKED.format(keys='label', u=sql_u(SEED, 'w1', 'id'))} AS rank FROM ids")
def _(spark, d):
    return exact_rank(ids(spark, d).withColumn("_u", u(SEED, "w1", "id")), ["label"], "_u", ["id"]).select("id", "label", "rank")


@query("w02_label_ordinal", f"WITH {IDS} SELECT id, dense_rank() OVER (ORDER BY label) AS ordinal FROM ids")
def _(spark, d):
    from pyspark.sql import Window as W

    own = ids(spark, d)
    table_ = own.select("label").distinct().withColumn("ordinal", F.dense_rank().over(W.orderBy("label")))
    return own.join(F.broadcast(table_), "label").select("id", F.col("ordinal").cast("long").alias("ordinal"))


@query("w03_running_total", f"WITH {ASSIGNED} SELECT client, label, (sum(count(*)) OVER (PARTITION BY label ORDER BY client))::BIGINT AS so_far FROM assigned GROUP BY client, label")
def _(spark, d):
    from pyspark.sql import Window as W

    n = assigned(spark, d).groupBy("client", "label").agg(F.count(F.lit(1)).alias("n"))
    frame = W.partitionBy("label").orderBy("client").rowsBetween(W.unboundedPreceding, 0)
    return n.select("client", "label", F.sum("n").over(frame).alias("so_far"))


