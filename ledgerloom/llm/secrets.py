"""Secret scan with DataFrame and SQL functions only.

Base patterns (assignments, access keys, long hex runs) are found with regular expressions; their offsets follow from
the lengths of the matches and of the gaps between them. Other long tokens are put to a battery of randomness tests on
the alphabet of their inferred encoding: chi-squared uniformity, a runs test about the middle of the alphabet, and
lag-1 serial correlation. Fisher's method combines the three. A random token's combined p is uniform on 0 to 1, an
ordinary token's is near 0: for each encoding and length band the number of random tokens is estimated from the upper
half of the histogram of p, and the bound on p is the lowest one at which the ordinary tokens among those accepted are
expected to be at most the share `fdr`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, documents_of

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # of AKIA and at least 16 characters in all: a shorter run holds no match
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

# Alphabets of the encodings, in their usual order.
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {"hex": _DIGITS + "abcdef", "base32": _UPPER + "234567", "base36": _DIGITS + _LOWER, "base26": _LOWER, "base62": _DIGITS + _UPPER + _LOWER, "base64": _UPPER + _LOWER + _DIGITS + "+/", "base64url": _UPPER + _LOWER + _DIGITS + "-_"}
LEAST = 20  # characters of a candidate
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{LEAST},}}"
BANDS = (24, 32, 40, 64)  # lengths at which a band begins, after the first
BINS = 20


def _before(df: DataFrame, values: str, name: str, op) -> DataFrame:
    """df with name: for each entry of the array `values` (numbers from 0 up) the op (a sum or a maximum) of those before it.

    Arrays can only be grown by copying them, so the scan is done in blocks of about the square root of their length, then
    over the blocks: the work is n times the root of n for n entries, instead of its square."""
    n = F.size(values)
    none = F.array().cast("array<bigint>")
    start = F.struct(F.lit(0).cast("bigint").alias("all"), none.alias("out"))
    step = lambda acc, x: F.struct(op(acc["all"], x).alias("all"), F.concat(acc["out"], F.array(acc["all"])).alias("out"))
    side = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double"))).cast("int"))
    cut_up = F.transform(F.sequence(F.lit(0), F.expr(f"cast((size({values}) - 1) div {_SIDE} as int)")), lambda k: F.slice(F.col(values), k * F.col(_SIDE) + 1, F.col(_SIDE)))
    out = df.withColumn(_SIDE, side).withColumn("_blocks", F.when(n > 0, F.transform(cut_up, lambda b: F.aggregate(b, start, step))))
    out = out.withColumn("_tops", F.aggregate(F.transform("_blocks", lambda b: b["all"]), start, step)["out"])
    whole = F.flatten(F.zip_with("_tops", "_blocks", lambda t, b: F.transform(b["out"], lambda x: op(t, x))))
    return out.withColumn(name, F.when(n > 0, whole).otherwise(none)).drop(_SIDE, "_blocks", "_tops")


_SIDE = "_side"
_SPOT = "array<struct<start:int,rank:int,end:int,match:string>>"


def _placed(df: DataFrame, text: str, pattern: str, kind: str, name: str) -> DataFrame:
    """df with name: array of (start, kind rank, end, match) of all matches in the column text, offsets in code points."""
    there = F.col(text).rlike(pattern)
    out = df.withColumn("_found", F.when(there, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("_gaps", F.when(there, F.transform(F.split(F.col(text), pattern, -1), lambda g: F.length(g).cast("bigint"))).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("_gaps", F.slice("_gaps", 1, F.size("_found")))
    out = out.withColumn("_steps", F.zip_with("_gaps", "_found", lambda g, m: g + F.length(m)))
    out = _before(out, "_steps", "_ahead", lambda a, b: a + b)
    begins = F.zip_with("_ahead", "_gaps", lambda a, g: a + g)
    spot = lambda b, m: F.struct(b.cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (b + F.length(m)).cast("int").alias("end"), m.alias("match"))
    return out.withColumn(name, F.zip_with(begins, "_found", spot).cast(_SPOT)).drop("_found", "_gaps", "_steps", "_ahead")


def _free(df: DataFrame, tokens: str, base: str) -> DataFrame:
    """df, its tokens without those that overlap a span of base. Tokens (at their end) and base spans (at their start) are
    sorted together; a token is free if no base span before it ends after the token's start."""
    event = lambda at, kind, reach, t: F.struct(at.alias("at"), F.lit(kind).alias("kind"), reach.cast("bigint").alias("reach"), t.alias("t"))
    none = F.lit(None).cast(_SPOT[6:-1])
    events = F.array_sort(F.concat(F.transform(tokens, lambda t: event(t["end"], 0, F.lit(0), t)), F.transform(base, lambda b: event(b["start"], 1, b["end"], none))))
    out = df.withColumn("_events", F.when(F.size(tokens) > 0, events).otherwise(F.array().cast(f"array<struct<at:int,kind:int,reach:bigint,t:{_SPOT[6:-1]}>>")))
    out = out.withColumn("_reach", F.transform("_events", lambda e: e["reach"]))
    out = _before(out, "_reach", "_reached", lambda a, b: F.greatest(a, b))
    kept = F.filter(F.zip_with("_events", "_reached", lambda e, r: F.when((e["kind"] == 0) & (r <= e["t"]["start"]), e["t"])), lambda t: t.isNotNull())
    return out.withColumn(tokens, kept).drop("_events", "_reach", "_reached")


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z), by the logistic approximation (error under 0.0002)."""
    x = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(1.5976 * x + 0.070566 * x * x * x))


def _encoding(token: Column) -> Column:
    digit, lower, upper = (token.rlike(f"[{x}]") for x in ("0-9", "a-z", "A-Z"))
    plain = F.length(F.regexp_replace(token, "[^A-Za-z0-9]", ""))
    return (
        F.when(~digit & ~(lower & upper), F.when(plain >= LEAST, "base26"))  # of one case, signs left out; null: rules of signs
        .when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(token.rlike("^[A-Z2-7]+$"), "base32")
        .when(token.rlike("^([a-z0-9]+|[A-Z0-9]+)$"), "base36")
        .when(token.rlike("[+/]") & ~token.rlike("[-_]"), "base64")
        .when(token.rlike("[-_]") & ~token.rlike("[+/]"), "base64url")
        .when(~token.rlike("[-_+/]"), "base62")
    )


def with_p(tokens: DataFrame) -> DataFrame:
    """tokens (match, enc, ...) with p: Fisher's combination of the three tests; near 0: not random."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    pairs = lambda c, f: total(F.zip_with(F.slice(c, 2, F.size(c)), F.slice(c, 1, F.size(c) - 1), f))
    low = lambda c: -F.log(F.greatest(F.least(c, F.lit(1.0)), F.lit(1e-12)))
    steps = [
        {"plain": F.when(F.col("enc").isin("hex", "base36", "base26"), F.lower("match")).otherwise(F.col("match")), "alphabet": F.coalesce(*[F.when(F.col("enc") == k, F.lit(a)) for k, a in ALPHABETS.items()])},
        {"k": F.length("alphabet").cast("double"), "number": F.filter(F.transform(F.split("plain", ""), lambda c: F.call_function("instr", F.col("alphabet"), c)), lambda v: v > 0)},
        {"n": F.size("number").cast("double"), "squares": total(F.transform(F.array_distinct("number"), lambda v: F.pow(F.size(F.filter("number", lambda w: w == v)), 2.0))), "high": F.transform("number", lambda v: (v * 2 > F.col("k") + 1).cast("double")), "mean": total("number") / F.size("number")},
        {"n1": total("high"), "changes": pairs("high", lambda a, b: F.abs(a - b)), "off": F.transform("number", lambda v: v - F.col("mean"))},
        {"expected": 2 * F.col("n1") * (F.col("n") - F.col("n1")) / F.col("n") + 1, "power": total(F.transform("off", lambda v: v * v)), "serial": pairs("off", lambda a, b: a * b)},
        {"spread": (F.col("expected") - 1) * (F.col("expected") - 2) / (F.col("n") - 1)},
        {
            "p_chi": _upper_tail((F.col("k") / F.col("n") * F.col("squares") - F.col("n") - (F.col("k") - 1)) / F.sqrt(2 * (F.col("k") - 1) * (F.col("n") - 1) / F.col("n"))),
            "p_runs": F.when(F.col("spread") <= 0, F.lit(1e-6)).otherwise(2 * _upper_tail(F.abs(F.col("changes") + 1 - F.col("expected")) / F.sqrt(F.greatest("spread", F.lit(1e-9))))),
            "p_serial": F.when(F.col("power") <= 0, F.lit(1e-6)).otherwise(2 * _upper_tail(F.abs(F.col("serial") / F.greatest("power", F.lit(1e-9)) + 1 / F.col("n")) * F.sqrt("n"))),
        },
        {"half": low(F.col("p_chi")) + low(F.col("p_runs")) + low(F.col("p_serial"))},
        {"p": F.exp(-F.col("half")) * (1 + F.col("half") + F.col("half") * F.col("half") / 2)},
    ]
    out = tokens
    for step in steps:
        out = out.withColumns(step)
    return out.select(*tokens.columns, "p")


def _band(length: Column) -> Column:
    return sum(((length >= b).cast("int") for b in BANDS), F.lit(0))


def marked(docs: DataFrame) -> DataFrame:
    """row, doc_id, base spans and candidate tokens of every whole text."""
    found = documents_of(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind, pattern in zip(KINDS, (ASSIGN, ACCESS, HEX, CANDIDATE), strict=True):
        found = _placed(found, "text", pattern, kind, kind)
    found = found.drop("text").withColumn("assign", F.filter("assign", lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 8))
    found = found.withColumn("base", F.array_sort(F.concat(*KINDS[:3])))
    found = _free(found, "random", "base").withColumnRenamed("random", "tokens")
    return found.select(F.monotonically_increasing_id().alias("row"), "doc_id", *[F.size(c).cast("long").alias(f"n_{c}") for c in KINDS[:3]], F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))).alias("base"), "tokens")


def _parts(tokens: DataFrame, pattern: str) -> DataFrame:
    """tokens, those with signs of both families cut into the long runs of pattern that they hold."""
    mixed = F.col("match").rlike("[+/]") & F.col("match").rlike("[-_]")
    cut_up = _placed(tokens.where(mixed), "match", pattern, "random", "parts").select("row", F.col("start").alias("from"), F.explode("parts").alias("t"))
    cut_up = cut_up.select("row", (F.col("from") + F.col("t.start")).alias("start"), "t.rank", (F.col("from") + F.col("t.end")).alias("end"), "t.match")
    return tokens.where(~mixed).union(cut_up)


def tested(rows: DataFrame) -> DataFrame:
    """A row for each candidate token: row, start, rank, end, enc, band, p. Tokens that no one encoding holds (paths,
    addresses) are cut at /, then at - and _."""
    t = rows.select("row", F.explode("tokens").alias("t")).select("row", "t.start", "t.rank", "t.end", "t.match")
    t = _parts(_parts(t, rf"[A-Za-z0-9+_-]{{{LEAST},}}"), rf"[A-Za-z0-9+/]{{{LEAST},}}")
    t = t.withColumns({"enc": _encoding(F.col("match")), "band": _band(F.length("match"))})
    return with_p(t.where("enc is not null")).drop("match")


def bounds(tests: DataFrame, fdr: float) -> dict[tuple[str, int], float]:
    """The lowest accepted p for each encoding and length band, from all candidates of the corpus.

    What is gathered is a histogram: BINS rows for each of the encodings and bands at most.
    """
    t = tests.select("enc", "band", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    table: dict[tuple[str, int], list[int]] = {}
    for enc, band, b, n in t.groupBy("enc", "band", "bin").count().collect():
        table.setdefault((enc, band), [0] * BINS)[b] = n
    out = {}
    for key, n in table.items():
        random = 2 * sum(n[BINS // 2 :])
        out[key] = 0.5
        for b in range(1, BINS // 2):
            accepted = sum(n[b:])
            if accepted and accepted - random * (1 - b / BINS) <= fdr * accepted:
                out[key] = b / BINS
                break
    return out


def secrets(docs: DataFrame, fdr: float = 0.1) -> DataFrame:
    """Finds secrets in every whole text.

    docs: doc_id, text; other columns are ignored. Null or empty text: no spans. Offsets are code points, ends are
    exclusive. Spans of the randomness tests are added where no base span overlaps. Repeated rows get equal results.
    Returns doc_id, n_assign, n_access, n_hex, base and all (arrays of start, kind rank, end), sorted by start and kind.
    """
    rows = cut(marked(docs))
    tests = cut(tested(rows))
    bound = [F.when((F.col("enc") == k) & (F.col("band") == b), F.lit(v)) for (k, b), v in sorted(bounds(tests, fdr).items())]
    accepted = tests.where(F.col("p") >= F.coalesce(*bound, F.lit(2.0)))
    more = accepted.groupBy("row").agg(F.collect_list(F.struct("start", "rank", "end")).alias("more"))
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return rows.join(more, "row", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base", every.alias("all"))


def spelled(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame, fdr: float = 0.1) -> DataFrame:
    return secrets(docs, fdr).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("all")).alias("spans"))
