"""Seeded draws as SQL expressions: normal quantiles, binomials, gammas.

A draw is a function of its uniforms, so it does not depend on partitioning, and its
cost does not depend on what is drawn from: a binomial of a billion trials takes a few
operations.  Numbers are written with exponents, which every SQL engine reads as doubles.
"""

from __future__ import annotations

# Coefficients of the rational approximations of the normal quantile (Wichura, AS 241),
# for the centre, the tails and the far tails, lowest order first.
CENTRE = (
    (3.3871328727963666080, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
TAIL = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def number(x: float) -> str:
    """A literal that SQL engines read as a double."""
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def _ratio(table: tuple, r: str) -> str:
    parts = []
    for numbers in table:
        text = number(numbers[-1])
        for c in reversed(numbers[:-1]):
            text = f"({number(c)} + {r} * {text})"
        parts.append(text)
    return f"{parts[0]} / {parts[1]}"


def normal(u: str) -> str:
    """The standard normal quantile of ``u``."""
    p = f"greatest(1e-16, least({u}, {number(1 - 2**-53)}))"
    q = f"({p} - 5e-1)"
    r = f"sqrt(-ln(least({p}, 1e0 - {p})))"
    tail = f"case when {r} <= 5e0 then {_ratio(TAIL, f'({r} - 1.6e0)')} else {_ratio(FAR, f'({r} - 5e0)')} end"
    return f"(case when abs({q}) <= 4.25e-1 then {q} * {_ratio(CENTRE, f'(1.80625e-1 - {q} * {q})')} else (case when {q} < 0 then -1e0 else 1e0 end) * ({tail}) end)"


#: From this variance on a binomial comes from its expansion; below, from its exact cumulated
#: probabilities, of which TERMS suffice.
WIDE, TERMS = 36, 144


def binomial(n: str, p: str, u: str, spark: bool = True) -> str:
    """SQL of the number of successes in ``n`` trials of probability ``p``: the quantile at ``u``.

    ``n``, ``p`` and ``u`` are columns, as they are named several times.  Below a variance of
    WIDE the quantile is exact.  From there on it is that of the Cornish-Fisher expansion to the
    skewness, whose cumulated probabilities are right to a few thousandths of one standard deviation.
    """
    small = f"least({p}, 1e0 - {p})"
    low = f"(case when {p} > 5e-1 then 1e0 - {u} else {u} end)"
    ratio = f"({small} / (1e0 - {small}))"
    first = f"exp({n} * ln(1e0 - {small}))"
    if spark:
        step = f"named_struct('k', a.k + if(a.cdf + a.pmf < {low}, 1, 0), 'pmf', a.pmf * ({n} - i) / (i + 1) * {ratio}, 'cdf', a.cdf + a.pmf)"
        exact = f"aggregate(sequence(0, {TERMS - 1}), named_struct('k', 0, 'pmf', {first}, 'cdf', 0e0), (a, i) -> {step}).k"
    else:
        step = f"{{'k': a.k + (a.cdf + a.pmf < {low})::INT, 'pmf': a.pmf * ({n} - x.i) / (x.i + 1) * {ratio}, 'cdf': a.cdf + a.pmf, 'i': x.i}}"
        rest = f"list_transform(range({TERMS}), lambda i: {{'k': 0, 'pmf': 0e0, 'cdf': 0e0, 'i': i}})"
        exact = f"list_reduce(list_concat([{{'k': 0, 'pmf': {first}, 'cdf': 0e0, 'i': 0::BIGINT}}], {rest}), lambda a, x: {step}).k"
    z, sigma = normal(low), f"sqrt({n} * {small} * (1e0 - {small}))"
    wide = f"floor({n} * {small} + {sigma} * {z} + (1e0 - 2e0 * {small}) * ({z} * {z} - 1e0) / 6e0 + 5e-1)"
    least_ = f"least(cast({n} as bigint), greatest(0, cast(case when {n} * {small} * (1e0 - {small}) < {WIDE} then {exact} else {wide} end as bigint)))"
    return f"(case when {n} <= 0 or {p} <= 0 then 0 when {p} >= 1 then cast({n} as bigint) when {p} > 5e-1 then cast({n} as bigint) - {least_} else {least_} end)"


#: Attempts of a gamma draw, each taken with a probability of 0.95 or more.
ATTEMPTS = 12


def gamma_attempt(shape: str, z: str) -> str:
    """What an attempt with the normal ``z`` gives for shape ``shape`` + 1 (Marsaglia and Tsang)."""
    d = f"({shape} + {number(2 / 3)})"
    v = f"(1e0 + {z} / sqrt(9e0 * {d}))"
    return f"({d} * {v} * {v} * {v})"


def gamma_taken(shape: str, z: str, u: str) -> str:
    """Whether the attempt is taken."""
    d = f"({shape} + {number(2 / 3)})"
    v = f"(1e0 + {z} / sqrt(9e0 * {d}))"
    return f"({v} > 0 and ln(greatest({u}, 1e-300)) < {z} * {z} / 2e0 + {d} - {d} * {v} * {v} * {v} + 3e0 * {d} * ln(greatest({v}, 1e-300)))"


def multinomial(n: str, shares: str, uniforms: str) -> str:
    """Spark SQL of how ``n`` trials fall on ``shares`` (an array that adds up to 1): an array
    of longs, each the binomial of what is left, by the uniform of its place."""
    one = binomial("s.n", "s.p", "s.u")
    kept = "named_struct('left', s.n - k, 'mass', s.mass - s.q, 'out', concat(s.out, array(k)))"
    fields = "'n', acc.left, 'mass', acc.mass, 'out', acc.out, 'q', v.p[j], 'p', if(acc.mass <= 0, 0e0, least(1e0, v.p[j] / acc.mass)), 'u', v.u[j], 'last', j = size(v.p) - 1"
    step = f"transform(array(named_struct({fields})), s -> transform(array(if(s.last, s.n, {one})), k -> {kept})[0])[0]"
    start = "named_struct('left', v.n, 'mass', 1e0, 'out', cast(array() as array<bigint>))"
    return f"transform(array(named_struct('n', cast({n} as bigint), 'p', {shares}, 'u', {uniforms})), v -> aggregate(sequence(0, size(v.p) - 1), {start}, (acc, j) -> {step}).out)[0]"


def gamma(shape: str, normals: str, uniforms: str, last: str) -> str:
    """Spark SQL of a gamma variate: the first attempt that is taken, from SQL of the uniform of
    attempt ``i``, times a power of ``last``, which brings shape + 1 down to shape."""
    z = normal("t.z")
    attempt = f"transform(array(named_struct('z', {normals}, 'u', {uniforms})), t -> transform(array(named_struct('z', {z}, 'u', t.u)), w -> if({gamma_taken(shape, 'w.z', 'w.u')}, {gamma_attempt(shape, 'w.z')}, null))[0])[0]"
    first = f"aggregate(sequence(0, {ATTEMPTS - 1}), cast(null as double), (a, i) -> if(a is not null, a, {attempt}))"
    return f"(coalesce({first}, {shape} + {number(2 / 3)}) * pow({last}, 1e0 / {shape}))"
