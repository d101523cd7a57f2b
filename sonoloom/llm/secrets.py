"""Secret scan: three fixed patterns, and a randomness test battery that adds spans. DataFrame functions only.

Battery: every run of 20 or more base64-like characters is read in the smallest encoding that fits (digits, hex,
base32 and base36 of either case, letters, base64 or its URL form), as a whole and, where such parts have 20
characters, as its runs of letters and digits, of one case and digits, of hex (the longest of each), and dashed hex without dashes.
Four statistics, each standard normal for independent uniform symbols, are taken of a reading: chi-squared of
the symbols and of their classes (upper, lower, digit, other; halves of the alphabet if it has one class), runs
of equal class, and lag-one serial correlation.

A reading is structured, and no secret, if the battery rejects randomness (Fisher, level ``STRUCTURED``). Else its
p-value is that of text: the chance that text of its length and encoding gives so small a sum of the four. For text
that sum grows with the square root of the length (``ENCODINGS``, fixed values measured on identifiers, slugs and
paths of English words), so short tokens need stronger evidence. The smallest p-value of a token's readings,
times their number, is its own. Over the whole corpus, in each of three classes of length, the Benjamini-Hochberg
step-up decides which tokens become ``random`` spans, so that at most a share ``LEVEL`` of them is text. P-values are rounded
up to a grid of tenths of a decade, so the step-up needs a histogram of 3 x 151 bins. Runs of digits, and of letters of one
case under some hundred characters, cannot be told from numbers and words and are not flagged.

Each text is looked at once: its spans are written to the shared scratch folder, the decision reads them there.

Defined results: null text is empty; texts without matches have counts 0 and empty span lists; equal
rows get equal spans and each counts as a token; an empty table gives an empty result; other columns
play no part. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sonoloom.plans.naming import fresh
from sonoloom.plans.scratch import materialise

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Symbols in the order of their codes, the class of each, and for text of n symbols the sum of the four
#: statistics: slope by sqrt(n), intercept, and spread at 20 symbols (it grows with the fourth root of n).
ENCODINGS = {
    "digits": (DIGITS, "A" * 5 + "B" * 5, 0.0, -100.0, 1.0),
    "hex": (DIGITS + "abcdef", "A" * 10 + "B" * 6, 2.5, -3.0, 2.0),
    "lower": (LOWER, "A" * 13 + "B" * 13, 0.80, -1.82, 2.0),
    "upper": (UPPER, "A" * 13 + "B" * 13, 0.80, -1.82, 2.0),
    "lower32": (LOWER + "234567", "A" * 26 + "B" * 6, 2.21, -5.20, 1.5),
    "upper32": (UPPER + "234567", "A" * 26 + "B" * 6, 2.21, -5.20, 1.5),
    "lower36": (LOWER + DIGITS, "A" * 26 + "B" * 10, 2.64, -5.92, 1.5),
    "upper36": (UPPER + DIGITS, "A" * 26 + "B" * 10, 2.64, -5.92, 1.5),
    "letters": (UPPER + LOWER, "A" * 26 + "B" * 26, 2.45, -2.51, 2.0),
    "base64": (UPPER + LOWER + DIGITS + "+/", "A" * 26 + "B" * 26 + "C" * 10 + "DD", 3.60, -6.08, 2.5),
}
LEVEL, STRUCTURED, LEAST_P, BINS = 0.05, 1e-4, 1e-15, 150
#: First lengths of the classes that the step-up decides apart.
LENGTHS = (20, 32, 64)
SPAN = "array<struct<start:int,kind:int,end:int>>"
MARK = "[SECRET]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _folded(items: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Spans that ``step`` (number so far, item) -> (number, spans) puts out over the items, from 0; in blocks of 256, so the work is in proportion to the items."""

    def zero(at: Column, kind: str) -> Column:
        return F.struct(at.alias("at"), F.array().cast(kind).alias("out"))

    def one(a: Column, x: Column) -> Column:
        at, out = step(a["at"], x)
        return F.struct(at.alias("at"), F.concat(a["out"], out).alias("out"))

    def all_blocks(every: Column) -> Column:
        def block(a: Column, b: Column) -> Column:
            own = F.aggregate(F.slice(every, b * 256 + 1, F.lit(256)), zero(a["at"], SPAN), one)
            return _let(own, lambda o: F.struct(o["at"].alias("at"), F.concat(a["out"], F.array(o["out"])).alias("out")))

        return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(every) / 256).cast("int")), zero(F.lit(0), f"array<{SPAN}>"), block, lambda a: F.flatten(a["out"]))

    return _let(items, all_blocks)


def _span(start: Column, kind: Column, end: Column) -> Column:
    return F.array(F.struct(start.alias("start"), kind.alias("kind"), end.alias("end")))


def _located(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    """Spans of the pattern's matches, leftmost and without overlap; with ``least``, those whose second group is that long."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    second = F.regexp_extract_all(text, F.lit(pattern), F.lit(2 if least else 0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(whole))
    steps = F.zip_with(F.zip_with(gaps, whole, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"))), second, lambda s, x: F.struct(s["g"].alias("g"), s["m"].alias("m"), (F.length(x) >= least).alias("ok")))

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        begin, end = at + s["g"], at + s["g"] + s["m"]
        return end, F.when(s["ok"], _span(begin, F.lit(kind), end)).otherwise(F.array().cast(SPAN))

    return F.when(text.rlike(pattern), _folded(steps, step)).otherwise(F.array().cast(SPAN))


def _added(own: Column, taken: Column) -> Column:
    """``own`` and the spans ``taken`` (struct<start, end>) that overlap none of them, by start, then kind."""
    event = lambda key, fixed, other: F.struct(key.alias("key"), F.lit(fixed).alias("fixed"), other.alias("other"))
    # a taken span comes after the fixed ones that start before its end: it overlaps one if any of these ends behind its start
    events = F.array_sort(F.concat(F.transform(own, lambda x: event(x["start"], 1, x["end"])), F.transform(taken, lambda x: event(x["end"], 0, x["start"]))))

    def step(far: Column, e: Column) -> tuple[Column, Column]:
        free = (e["fixed"] == 0) & (far <= e["other"])
        return F.when(e["fixed"] == 1, F.greatest(far, e["other"])).otherwise(far), F.when(free, _span(e["other"], F.lit(4), e["key"])).otherwise(F.array().cast(SPAN))

    return F.when(F.size(taken) > 0, F.array_sort(F.concat(own, _folded(events, step)))).otherwise(own)


def fixed_spans(text: Column) -> Column:
    """Spans of the three fixed kinds by start, then kind."""
    return F.array_sort(F.concat(_located(text, ASSIGN, 1, 6), _located(text, ACCESS, 2), _located(text, HEX, 3)))


def _tail(x: Column) -> Column:
    """Chance that a standard normal number is over x: 0.5 for small x, else its usual bound from above."""
    return F.when(x < 0.8, F.lit(0.5)).otherwise(F.greatest(F.lit(LEAST_P), F.exp(-x * x / 2) / (x * 2.5066282746310002)))


def _p_value(r: Column) -> Column:
    """P-value of text for a reading: struct<symbols, alphabet, classes, k, a, b, c, d, slope, level, spread>."""
    n = F.length(r["symbols"]).cast("double")
    many = lambda text, s: (F.length(text) - F.length(F.replace(text, s, F.lit("")))).cast("double")
    squares = F.aggregate(F.split(r["alphabet"], ""), F.lit(0.0), lambda t, s: t + _let(many(r["symbols"], s), lambda x: x * x))
    classes = F.call_function("translate", r["symbols"], r["alphabet"], r["classes"])
    shares = [r[x] for x in "abcd"]

    def normal(chi: Column, df: Column) -> Column:  # Wilson-Hilferty
        return (F.cbrt(chi / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))

    def of_classes(text: Column) -> Column:
        chi = sum((_let(many(text, F.lit(s)) - n * p, lambda x: x * x) / F.greatest(n * p, F.lit(1e-9)) for s, p in zip("ABCD", shares)), F.lit(0.0))
        df = sum(((p > 0).cast("double") for p in shares), F.lit(-1.0))
        runs = F.length(F.regexp_replace(text, "A+|B+|C+|D+", "x")).cast("double")
        q, cubes = sum((p * p for p in shares), F.lit(0.0)), sum((p * p * p for p in shares), F.lit(0.0))
        spread = F.sqrt((n - 1) * q * (1 - q) + 2 * (n - 2) * (cubes - q * q))
        return F.struct(normal(chi, df).alias("g"), ((1 + (n - 1) * (1 - q) - runs) / spread).alias("r"))

    def serial(codes: Column) -> Column:
        zero = F.struct(*(F.lit(0.0).alias(x) for x in ("last", "s", "ss", "lag")))
        sums = F.aggregate(codes, zero, lambda t, x: F.struct(x.alias("last"), (t["s"] + x).alias("s"), (t["ss"] + x * x).alias("ss"), (t["lag"] + t["last"] * x).alias("lag")))

        def value(t: Column) -> Column:
            mean = t["s"] / n
            own = t["ss"] - n * mean * mean
            lagged = t["lag"] - mean * (2 * t["s"] - codes[0] - t["last"]) + (n - 1) * mean * mean
            return F.when(own < 1e-6, F.lit(99.0)).otherwise((lagged / F.when(own >= 1e-6, own) + 1 / n) * F.sqrt(n))

        return _let(sums, value)

    codes = F.transform(F.split(r["symbols"], ""), lambda x: F.position(x, r["alphabet"]).cast("double"))

    def joined(z: Column) -> Column:
        half = -sum((F.log(2 * _tail(F.abs(z[x]))) for x in ("u", "g", "r", "s")), F.lit(0.0))
        random = F.exp(-half) * (1 + half + half * half / 2 + half * half * half / 6)  # chi-squared with eight degrees of freedom
        total = z["u"] + z["g"] + z["r"] + F.abs(z["s"])
        text = _tail((r["slope"] * F.sqrt(n) + r["level"] - total) / (r["spread"] * F.pow(n / 20, F.lit(0.25))))
        return F.when(random < STRUCTURED, F.lit(1.0)).otherwise(text)

    z = _let(classes, of_classes)
    return _let(F.struct(normal(squares * r["k"] / n - n, r["k"] - 1).alias("u"), z["g"].alias("g"), z["r"].alias("r"), _let(codes, serial).alias("s")), joined)


def _which(name: str) -> Column:
    alphabet, classes, slope, level, spread = ENCODINGS[name]
    k = len(alphabet)
    shares = [F.lit(classes.count(c) / k).alias(c.lower()) for c in "ABCD"]
    return F.struct(F.lit(alphabet).alias("alphabet"), F.lit(classes).alias("classes"), F.lit(float(k)).alias("k"), *shares, F.lit(slope).alias("slope"), F.lit(level).alias("level"), F.lit(spread).alias("spread"))


def _smallest(token: Column) -> Column:
    """The smallest encoding that fits."""
    return (
        F.when(token.rlike("^[0-9]+$"), _which("digits"))
        .when(token.rlike("^[a-z]+$"), _which("lower"))
        .when(token.rlike("^[A-Z]+$"), _which("upper"))
        .when(token.rlike("^[0-9a-f]+$") | token.rlike("^[0-9A-F]+$"), _which("hex"))
        .when(token.rlike("^[A-Za-z]+$"), _which("letters"))
        .when(token.rlike("^[a-z2-7]+$"), _which("lower32"))
        .when(token.rlike("^[A-Z2-7]+$"), _which("upper32"))
        .when(token.rlike("^[a-z0-9]+$"), _which("lower36"))
        .when(token.rlike("^[A-Z0-9]+$"), _which("upper36"))
        .otherwise(_which("base64"))
    )


def _readings(token: Column) -> Column:
    """array<struct<symbols, ...>>: the whole token and the longest parts of 20 or more symbols that may be random in it."""
    longer = lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a)
    parts = [F.filter(F.array(F.aggregate(F.regexp_extract_all(token, F.lit(p), F.lit(0)), F.lit(""), longer)), lambda x: x != "") for p in ("[0-9A-Za-z]{20,}", "[0-9a-z]{20,}", "[0-9A-Z]{20,}", "[0-9a-f]{20,}|[0-9A-F]{20,}")]
    bare = F.translate(token, "-", "")
    dashed = F.when(token.rlike("^[0-9a-fA-F]+(-[0-9a-fA-F]+)+$") & (F.length(bare) >= 20), F.array(bare)).otherwise(F.array().cast("array<string>"))

    def reading(symbols: Column) -> Column:
        def told(w: Column) -> Column:
            plain = F.translate(F.when(w["k"] == 16, F.lower(symbols)).otherwise(symbols), "-_", "+/")
            return F.struct(plain.alias("symbols"), *(w[x].alias(x) for x in ("alphabet", "classes", "k", "a", "b", "c", "d", "slope", "level", "spread")))

        return _let(_smallest(symbols), told)

    return F.transform(F.array_distinct(F.concat(F.array(token), *parts, dashed)), reading)


def tested(text: Column) -> Column:
    """array<struct<start, end, p>> of all tokens."""

    def one(span: Column, token: Column) -> Column:
        return _let(_readings(token), lambda rs: measured(rs, span))

    def measured(rs: Column, span: Column) -> Column:
        p = F.aggregate(rs, F.lit(1.0), lambda a, r: F.least(a, _p_value(r)))
        return F.struct(span["start"].alias("start"), span["end"].alias("end"), F.least(F.lit(1.0), p * F.size(rs)).alias("p"))

    return F.zip_with(_located(text, TOKEN, 4), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), one)


def _class(length: Column) -> Column:
    return sum(((length >= x).cast("int") for x in LENGTHS[1:]), F.lit(0))


def _bin(p: Column) -> Column:
    return F.least(F.lit(BINS), F.floor(-10 * F.log10(F.greatest(F.lit(LEAST_P), p)))).cast("int")


class Flagged:
    """The corpus decision: in each class of length, tokens in this bin of p-values or a later one are random (None: none are)."""

    def __init__(self, bins: list[int | None]):
        self.bins = bins

    def takes(self, t: Column) -> Column:
        length = t["end"] - t["start"]
        least = F.lit(BINS + 1)
        for c, b in enumerate(self.bins):
            least = F.when(_class(length) == c, F.lit(BINS + 1 if b is None else b)).otherwise(least)
        return _bin(t["p"]) >= least


def decide(tokens: DataFrame, level: float = LEVEL) -> Flagged:
    """The step-up over ``tokens`` (length, p) in each class of length; the driver gets 3 x 151 rows at most."""
    rows = tokens.groupBy(_class(F.col("length")).alias("c"), _bin(F.col("p")).alias("bin")).agg(F.count("*").alias("n")).collect()
    bins = []
    for c in range(len(LENGTHS)):
        own = {r["bin"]: r["n"] for r in rows if r["c"] == c}
        m, later, found = sum(own.values()), 0, None
        for b in sorted(own, reverse=True):
            later += own[b]
            found = b if 10 ** (-b / 10) * m <= level * later else found
        bins.append(found)
    return Flagged(bins)


def scan(docs: DataFrame, text_col: str = "text", level: float = LEVEL, drop: bool = True) -> tuple[DataFrame, str, str]:
    """(``docs`` with two more columns, their names): fixed spans and all spans, as arrays of struct<start, kind, end> by start, then kind; kinds count from 1."""
    fixed, tokens = fresh(docs, "fixed", "tokens")
    text = F.coalesce(F.col(text_col), F.lit(""))
    seen = docs.withColumns({fixed: fixed_spans(text), tokens: tested(text)})
    seen = materialise(seen.drop(text_col) if drop else seen, "scanned")
    each = seen.select(F.explode(tokens).alias("t")).select((F.col("t.end") - F.col("t.start")).alias("length"), F.col("t.p").alias("p"))
    flagged = decide(each, level)
    every = _added(F.col(fixed), F.filter(tokens, flagged.takes))
    return seen.withColumn(tokens, every), fixed, tokens


def listed(found: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Fixed value: the encoding of as many bytes for each code point.
WIDE = "UTF-32"


def redact(docs: DataFrame, text_col: str = "text", mark: str = MARK) -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by ``mark``; overlapping spans give one mark, null text stays null."""
    text = F.col(text_col)
    seen, fixed, every = scan(docs, text_col, drop=False)
    ahead = lambda at, s: (F.greatest(at, s["end"]), F.when(s["start"] >= at, _span(at, F.lit(0), s["start"])).otherwise(F.array().cast(SPAN)))
    last = F.struct(F.array_max(F.transform(every, lambda s: s["end"])).alias("start"), F.lit(0).alias("kind"), F.length(text).alias("end"))
    kept = F.concat(_folded(F.col(every), ahead), F.array(last))  # what lies between the spans
    # four bytes for each code point, so that a part is cut out without a look at what precedes it
    cut = _let(F.encode(text, WIDE), lambda wide: F.array_join(F.transform(kept, lambda g: F.decode(F.substring(wide, 4 * g["start"] + 1, 4 * (g["end"] - g["start"])), WIDE)), mark))
    return seen.withColumn(text_col, F.when(F.size(every) > 0, cut).otherwise(text)).drop(fixed, every).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, fixed, every = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter(fixed, lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count(1).alias("n_assign"), count(2).alias("n_access"), count(3).alias("n_hex"), F.sha2(listed(F.col(fixed)), 256).alias("base_sha256"), listed(F.col(every)).alias("spans"))
