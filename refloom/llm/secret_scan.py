"""Operator 1: secrets in text by pattern and by a battery of randomness tests, in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refloom.llm.common import cut

# The patterns of the three base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a leftmost run of hex digits is as long as it can be, so shorter ones need no match
#: Candidates of the randomness tests: runs of the symbols of all known encodings.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/-_"
#: Share of false ones that all reported random strings of a table may have.
FALSE_DISCOVERY = 0.05

# The null hypothesis: names, paths, slugs and numbered words, measured on such tokens made of the words of four languages.
#: Share of symbol pairs (and triples) of one token that are equal, for letters and for hex digits.
EQUAL_PAIRS, EQUAL_TRIPLES, HEX_PAIRS, HEX_TRIPLES = 0.062, 0.005, 0.1, 0.012
#: How often digit, lower case, upper case and sign follow each other in random strings of 16, 32, 36, 62 and 64 symbols, and what share of it ordinary tokens have.
CHANGES, ORDINARY_CHANGES = {16: 0.46875, 32: 0.3047, 36: 0.4012, 62: 0.6222, 64: 0.6455}, 0.6
#: Serial correlation of the symbols' numbers, in absolute value.
SERIAL = 0.25
#: Probabilities are kept as -ln(p) in steps of a fiftieth, rounded to the larger probability; beyond the last step they count as equal.
STEPS, LAST_STEP = 50, 20_000


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def running(source: str, ddl: str, state: str, step: str, out: str) -> str:
    """SQL: array of type ddl with what `out` gives for each element x of an array, at the state a.v after the elements before it.

    The state starts as `state` and goes on as `step`. An array that grows by one element is copied each time, so elements are taken in
    stretches of about the root of their number.
    """
    empty = f"cast(array() AS {ddl})"
    stretch = f"aggregate(slice(z, 1 + i * w, w), named_struct('v', b.v, 'found', {empty}), (a, x) -> named_struct('v', {step}, 'found', array_append(a.found, {out})), r -> named_struct('v', r.v, 'found', concat(b.found, r.found)))"
    every = f"aggregate(sequence(0, cast((size(z) - 1) div w AS int)), named_struct('v', {state}, 'found', {empty}), (b, i) -> {stretch}, b -> b.found)"
    return f"transform(array({source}), z -> CASE WHEN size(z) = 0 THEN {empty} ELSE transform(array(cast(ceil(sqrt(size(z))) AS int)), w -> {every})[0] END)[0]"


PLACED = "array<struct<s:int,from:int,value:string>>"


def placed(text: str, pattern: str, matches: str) -> str:
    """SQL: array of (s, from, value) of the matches, which regexp_extract_all() has found in the text; s counts code points, from bytes.

    What lies between the matches comes from split(); running lengths of both give the places.
    """
    pieces = f"filter(zip_with(split({text}, '{_quoted(pattern)}', -1), {matches}, (g, v) -> struct(g AS gap, v AS value)), x -> x.value IS NOT NULL)"
    step = "named_struct('s', a.v.s + length(x.gap) + length(x.value), 'b', a.v.b + octet_length(x.gap) + octet_length(x.value))"
    out = "named_struct('s', a.v.s + length(x.gap), 'from', a.v.b + octet_length(x.gap), 'value', x.value)"
    return f"CASE WHEN size({matches}) = 0 THEN cast(array() AS {PLACED}) ELSE {running(pieces, PLACED, "named_struct('s', 0, 'b', 0)", step, out)} END"


def normal_tail(z: str) -> str:
    """SQL: natural logarithm of the upper tail of the normal distribution, by the bound of Boerjesson and Sundberg (relative error under 0.3 %)."""

    def tail(x: str) -> str:
        return f"exp(-{x} * {x} / 2D) / (2.5066282746D * (0.661D * {x} + 0.339D * sqrt({x} * {x} + 5.51D)))"

    high = f"least(abs({z}), 37D)"
    return f"CASE WHEN {z} >= 0 THEN ln({tail(high)}) ELSE ln(1D - {tail(high)}) END"


def battery(value: str) -> str:
    """SQL: struct of k (inferred encoding), n (length), the scores z1, z2, z3 of the tests and z of all for one candidate.

    Encoding: the smallest alphabet that holds all symbols: hex (16), base32 (32), digits and letters of one case (36) or both (62), base64 or its URL
    form (64). Each score says by how many deviations the candidate is more random than ordinary tokens of its length are, which is the null
    hypothesis. Chi-squared: its only varying part, the number of equal pairs of symbols, is lower. Runs: digits, lower case, upper case and signs
    change more often. Serial correlation: the symbol's numbers hardly follow from the ones before. The mean score of the three has its own deviation.
    """
    size = f"""CASE WHEN {value} rlike '^([0-9a-f]+|[0-9A-F]+)$' THEN 16 WHEN {value} rlike '^[A-Z2-7]+$' THEN 32 WHEN {value} rlike '^([0-9a-z]+|[0-9A-Z]+)$' THEN 36
        WHEN {value} rlike '^[0-9A-Za-z]+$' THEN 62 ELSE 64 END"""
    symbols = f"split('{ALPHABET}', '')"
    pairs = f"aggregate(transform(filter({symbols}, c -> c <> ''), c -> length({value}) - length(replace({value}, c, ''))), 0D, (a, m) -> a + m * (m - 1D) / 2)"
    runs = f"length(regexp_replace({value}, '[0-9]+|[a-z]+|[A-Z]+|[+/_-]+', '.')) - 1D"
    # code of a symbol: its place in the alphabet of its encoding
    code = "ascii(cast(substring(e.b, i, 1) AS string))"
    number = f"""CASE WHEN e.k = 32 THEN CASE WHEN {code} >= 65 THEN {code} - 65 ELSE {code} - 24 END
        WHEN {code} BETWEEN 48 AND 57 THEN {code} - 48 WHEN {code} >= 97 THEN {code} - 87
        WHEN {code} BETWEEN 65 AND 90 THEN {code} - CASE WHEN e.k IN (16, 36) THEN 55 ELSE 29 END WHEN {code} = 43 THEN 62 ELSE 63 END"""
    walk = f"""aggregate(sequence(1, e.n), named_struct('last', 0D, 'first', 0D, 'sum', 0D, 'square', 0D, 'product', 0D),
        (a, i) -> transform(array(cast({number} AS double)), x -> named_struct('last', x, 'first', CASE WHEN i = 1 THEN x ELSE a.first END, 'sum', a.sum + x, 'square', a.square + x * x, 'product', a.product + CASE WHEN i = 1 THEN 0D ELSE x * a.last END))[0])"""

    fields: list[str] = []

    def bind(source: str, **new: str) -> str:
        keep = [f"e.{f} AS {f}" for f in fields]
        fields.extend(new)
        return f"transform({source}, e -> struct({', '.join([*keep, *(f'{v} AS {n}' for n, v in new.items())])}))"

    two, three = (f"CASE WHEN e.k = 16 THEN {a}D ELSE {b}D END" for a, b in ((HEX_PAIRS, EQUAL_PAIRS), (HEX_TRIPLES, EQUAL_TRIPLES)))
    x = f"array(struct({size} AS k, length({value}) AS n, cast({value} AS binary) AS b, {pairs} AS pairs, {runs} AS changes))"
    fields += ["k", "n", "b", "pairs", "changes"]
    x = bind(x, w=walk, q=two, t=three, c=f"{ORDINARY_CHANGES}D * CASE e.k {' '.join(f'WHEN {k} THEN {v}D' for k, v in CHANGES.items())} END")
    x = bind(x, mean="e.w.sum / e.n", m2="e.n * (e.n - 1D) / 2", m3="e.n * (e.n - 1D) * (e.n - 2D)")
    x = bind(x, spread="e.w.square - e.n * e.mean * e.mean", serial="e.w.product - e.mean * (2 * e.w.sum - e.w.first - e.w.last) + (e.n - 1) * e.mean * e.mean")
    x = bind(
        x,
        z1="(e.m2 * e.q - e.pairs) / sqrt(e.m2 * (e.q - e.q * e.q) + e.m3 * (e.t - e.q * e.q))",
        z2="(e.changes - (e.n - 1) * e.c) / sqrt((e.n - 1) * e.c * (1 - e.c))",
        z3=f"CASE WHEN e.spread <= 0 THEN -{1 - SERIAL}D ELSE {SERIAL}D - abs(e.serial / e.spread) END * sqrt(e.n)",
    )
    return f"transform({x}, e -> struct(e.k AS k, e.n AS n, e.z1 AS z1, e.z2 AS z2, e.z3 AS z3, (e.z1 + e.z2 + e.z3) / sqrt(3D) AS z))[0]"


#: Weight of a candidate in the false-discovery control by its length: long ones, which the tests can tell, get more of the level than short ones.
WEIGHT = "least(2D, greatest(0.5D, y.n / 40D))"


def candidates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id_column, the columns in carry, base (array of start, kind_no, kind, end, from, to) and tested: start, end, from, to, z, weight, step of each
    candidate of the randomness tests. step: -ln(p / weight) in STEPS, rounded down."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    found = docs.select(F.col(id_column), *carry, text.alias("_text"))
    patterns = {"_assign": ASSIGN, "_access": ACCESS, "_hex": HEX, "_random": CANDIDATE}
    found = found.withColumns({name: F.regexp_extract_all("_text", F.lit(p), F.lit(0)) for name, p in patterns.items()})
    found = found.withColumns({name: F.expr(placed("_text", p, name)) for name, p in patterns.items()})

    def spans(source: str, number: int) -> str:
        return f"transform({source}, m -> struct(m.s AS start, {number} AS kind_no, '{KINDS[number]}' AS kind, m.s + length(m.value) AS end, m.from AS from, m.from + octet_length(m.value) AS to))"

    kept = [f"filter(_assign, m -> length(regexp_extract(m.value, '{_quoted(ASSIGN)}', 1)) >= 6)", "filter(_access, m -> length(m.value) >= 20)", "_hex"]
    found = found.withColumn("base", F.expr(f"array_sort(concat({', '.join(spans(k, n) for n, k in enumerate(kept))}))"))
    # a candidate that overlaps a base span drops out: one pass to the right knows how far the spans before it reach, one to the left where the next begins
    event = "struct<s:int,e:int,from:int,value:string,clash:boolean>"
    events = "array_sort(concat(transform(base, m -> struct(m.start AS s, m.end AS e, 0 AS from, cast(null AS string) AS value)), transform(fresh, m -> struct(m.s AS s, m.s + length(m.value) AS e, m.from AS from, m.value AS value))))"
    out = "named_struct('s', x.s, 'e', x.e, 'from', x.from, 'value', x.value, 'clash', {})"
    right = running(events, f"array<{event}>", "0", "CASE WHEN x.value IS NULL THEN greatest(a.v, x.e) ELSE a.v END", out.format("a.v > x.s"))
    left = running(f"reverse({right})", f"array<{event}>", str((1 << 31) - 1), "CASE WHEN x.value IS NULL THEN x.s ELSE a.v END", out.format("x.clash OR a.v < x.e"))
    fresh = "filter(_random, m -> m.value rlike '[0-9]' AND m.value rlike '[A-Za-z]')"
    alone = f"transform(array({fresh}), fresh -> CASE WHEN size(fresh) = 0 THEN cast(array() AS array<{event}>) ELSE filter({left}, m -> m.value IS NOT NULL AND NOT m.clash) END)[0]"
    tested = f"transform(_alone, m -> struct(m.s AS start, m.e AS end, m.from AS from, m.from + octet_length(m.value) AS to, {battery('m.value')} AS y))"
    found = found.withColumn("_alone", F.expr(alone)).withColumn("_tested", F.expr(tested))
    step = f"cast(greatest(0D, least({LAST_STEP}D, floor({STEPS} * (ln({WEIGHT}) - ({normal_tail('y.z')}))))) AS int)"
    judged = f"transform(_tested, m -> transform(array(m.y), y -> struct(m.start AS start, m.end AS end, m.from AS from, m.to AS to, y.z AS z, {WEIGHT} AS weight, {step} AS step))[0])"
    return found.select(id_column, *carry, "base", F.expr(judged).alias("tested"))


def discovery_line(judged: DataFrame, rate: float) -> int:
    """The least step that a reported candidate needs: weighted step-up of Benjamini and Hochberg over all candidates of the table.

    The k candidates from a step on are reported if the step's probability times the sum of all weights is at most k times the rate. Candidates are
    counted by step first, so LAST_STEP + 1 rows are ranked however large the table is; the driver sees the line alone.
    """
    steps = judged.select(F.explode("tested").alias("t")).groupBy("t.step").agg(F.count("*").alias("n"), F.sum("t.weight").alias("weight"))
    down = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = steps.select("step", F.sum("n").over(down).alias("k"), F.sum("weight").over(whole).alias("total"))
    line = ranked.where(F.exp(-F.col("step") / F.lit(float(STEPS))) * F.col("total") <= F.lit(rate) * F.col("k")).agg(F.min("step")).first()[0]
    return LAST_STEP + 1 if line is None else line


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = (), rate: float = FALSE_DISCOVERY) -> DataFrame:
    """Spans of secrets in every whole text: id_column, the columns in carry, base and found (arrays of start, kind_no, kind, end, from, to, by start and kind).

    assign: a value of 6 or more characters after a word such as password. access: an access key id of 20 or more characters. hex: 24 or more
    lower-case hex digits. random: a run of 20 or more encoding symbols with letters and digits, apart from all of the former, that is more random
    than ordinary tokens.

    battery() tests each candidate against the hypothesis that it is an ordinary token. All candidates of the table are one family, of whose reported
    members a share of `rate` at most is expected to be false; weights by length give long candidates more of the level. So what is reported
    of the random kind depends on the table, the base kinds don't. Probabilities hold for the null hypothesis as it is stated above; tokens
    of another make can be more random than that.

    Places are code points (start, end) and bytes (from, to), ends exclusive. Null and empty texts have no spans. Ties, repeats and order don't matter.
    """
    judged = cut(candidates(docs, id_column, text_column, carry))
    line = discovery_line(judged, rate)
    random = f"transform(filter(tested, x -> x.step >= {line}), x -> struct(x.start AS start, 3 AS kind_no, 'random' AS kind, x.end AS end, x.from AS from, x.to AS to))"
    return judged.withColumn("found", F.expr(f"array_sort(concat(base, {random}))")).select(id_column, *carry, "base", "found")


def listed(spans: str) -> str:
    """SQL: kind:start:end of all spans, comma-joined."""
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"


def redact(docs: DataFrame, text_column: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with each maximal stretch of overlapping or touching spans replaced by the mask; other columns stay. Null texts stay null."""
    names = docs.columns
    found = scan(docs.select(F.struct(*names).alias("_row"), F.col(text_column)), "_row", text_column)
    # what lies before a span, if anything does, then the mask; a span that touches the last one adds nothing
    gap = "substring(cast(_row.{text} AS binary), a.v + 1, x.from - a.v)"
    piece = f"CASE WHEN x.from > a.v OR a.v = 0 THEN concat(cast({gap} AS string), '{{mask}}') ELSE '' END"
    pieces = running("found", "array<string>", "0", "greatest(a.v, x.to)", piece)
    kept = f"concat(array_join({pieces}, ''), cast(substring(cast(_row.{{text}} AS binary), array_max(transform(found, x -> x.to)) + 1) AS string))"
    kept = kept.replace("{text}", f"`{text_column}`").replace("{mask}", _quoted(mask))
    text = F.when(F.size("found") == 0, F.col(f"_row.{text_column}")).otherwise(F.expr(kept))
    return found.select(*(text.alias(n) if n == text_column else F.col(f"_row.{n}").alias(n) for n in names))
