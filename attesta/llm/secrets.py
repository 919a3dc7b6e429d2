"""Secret scans with DataFrame functions only: fixed patterns, and a battery of randomness tests under false-discovery control."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, fresh

# The patterns of the three kinds that are always reported.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a run of 18 or more; shorter runs hold no match that starts later and is longer
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 12

#: What the battery looks at: runs of characters that encodings use.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Rates of changes between character classes that ordinary names and words stay under, in mixed case and where letters have one case, so that only changes to and from
#: digits count; and the false-discovery rate.
CHANGES, ONE_CASE, FALSE = 0.15, 0.05, 0.01
#: Rate of changes between vowels and consonants that runs of letters of one case stay over, and their least length: shorter ones count as words.
SPOKEN, LETTERS = 0.5, 28
#: Lengths that begin a band; each band has a cut of its own, since short strings give weaker evidence and are far more frequent.
BANDS = (20, 28, 40, 64)
#: p-values are counted in bins of a quarter of a natural logarithm.
BINS, LAST_BIN = 4, 400
#: Elements that are summed together where sums run along an array.
RUN = 256
#: Code points of one part of a text that is cut into pieces.
PART = 1 << 16
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="

_SPAN = "array<struct<start:long,end:long,value:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, zero: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array what all elements before it join to. Blocks are joined first, so that long arrays don't take the square of their length."""
    fold = lambda x: F.aggregate(x, zero, join)
    blocks = F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")), lambda b: fold(F.slice(values, b * RUN + 1, F.lit(RUN)))))
    before = lambda own: F.transform(own, lambda _, b: fold(F.slice(own, F.lit(1), b)))
    block = lambda i: F.floor(i / F.lit(RUN)).cast("int")
    all_of = lambda heads: F.transform(values, lambda _, i: join(heads[block(i)], fold(F.slice(values, block(i) * RUN + 1, i % RUN))))
    return F.when(F.size(values) > 0, _let(blocks, lambda x: _let(before(x), all_of)))


def _found(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches with their places in code points. Texts without one are not split."""

    def places(one: Column) -> Column:
        hits, gaps = one["hits"], F.transform(F.slice(one["parts"], F.lit(1), F.size(one["hits"])), lambda g: F.length(g).cast("long"))
        both = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), F.length(h).cast("long").alias("length"), h.alias("hit")))
        steps = lambda rows: _running(F.transform(rows, lambda r: r["gap"] + r["length"]), F.lit(0).cast("long"), lambda x, y: x + y)
        span = lambda r, at: F.struct((at + r["gap"]).alias("start"), (at + r["gap"] + r["length"]).alias("end"), r["hit"].alias("value"))
        return _let(both, lambda rows: F.zip_with(rows, steps(rows), span))

    once = F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(F.rlike(text, F.lit(pattern)), _let(once, places)).otherwise(F.array().cast(_SPAN))


def _kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> of the fixed patterns, by start and then kind."""
    long_enough = F.filter(_found(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= LEAST_VALUE)
    return F.array_sort(F.concat(_kind(long_enough, "assign"), _kind(_found(text, ACCESS), "access"), _kind(_found(text, HEX), "hex")))


def _class(c: Column) -> Column:
    return F.when(c.between("a", "z"), 1).when(c.between("A", "Z"), 2).when(c.between("0", "9"), 3).otherwise(4)


def _below(z: Column) -> Column:
    """The odds that a normal number is below z, by a logistic curve that stays within 0.0002 and is right in order of magnitude in both tails."""
    return 1 / (1 + F.exp(-F.least(F.greatest(z * (1.5976 + 0.07056 * z * z), F.lit(-600.0)), F.lit(600.0))))


def _cauchy(p: Column, q: Column) -> Column:
    """cot(pi p), given q = 1 - p as well so that neither end is lost."""
    pi = math.pi
    safe = lambda x: F.greatest(x, F.lit(1e-290))
    return F.when(p <= 0.5, 1 / F.tan(safe(p) * pi)).otherwise(-1 / F.tan(safe(q) * pi))


def _evidence(text: Column, n: Column, size: Column, letters: Column, squares: Column, correlation: Column, changed: Column) -> Column:
    """-log of the combined p-value of the three tests, zero or more.

    Each p-value is small for what random characters do and ordinary text doesn't: counts no further from even than chance puts them (chi-squared, as a normal number by the
    cube root), neighbours that correlate no more than chance makes them, and changes of class at a rate that text doesn't have, by the bound exp(-n KL(rate, text's rate)). They
    depend on each other, so they are joined by the Cauchy combination, which holds all the same; a test that is sure of text outweighs what the others found.
    """
    free = size - 1
    chi = squares * size / n - n
    z = (F.pow(chi / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    r = F.abs(correlation) * F.sqrt(n)
    rate = changed / (n - 1)
    safe = F.least(F.greatest(rate, F.lit(0.001)), F.lit(0.999))
    unlike = (n - 1) * (safe * F.log(safe / text) + (1 - safe) * F.log((1 - safe) / (1 - text)))
    random = F.when(letters, (rate < text) & (n >= LETTERS)).otherwise(rate > text)
    runs = F.when(random, F.exp(-F.least(unlike, F.lit(600.0)))).otherwise(F.lit(1.0))
    even, apart = _below(z), 2 * _below(r) - 1
    parts = [_cauchy(even, _below(-z)), _cauchy(apart, 2 * _below(-r)), _cauchy(runs, 1 - runs)]
    t = (parts[0] + parts[1] + parts[2]) / 3
    return F.when(random, F.when(t > 1e3, F.log(t * math.pi)).otherwise(F.greatest(-F.log(0.5 - F.atan(t) / math.pi), F.lit(0.0)))).otherwise(F.lit(0.0))


def _tested(span: Column) -> Column:
    """A candidate with its evidence against ordinary text, as a bin of the combined p-value's logarithm.

    The encoding is inferred from the characters: hexadecimal, letters, base 32 or base 36 in one case, base 62, or base 64. It says how many different characters chance would
    spread evenly over, and what changes of class text of its kind has: between lower case, upper case, digits and signs, or, in letters of one case, between vowels and consonants.
    """
    value = F.rtrim(span["value"], F.lit("="))
    size = F.lit(64.0)
    for k, own in ((62, "[A-Za-z0-9]+"), (36, "[a-z0-9]+|[A-Z0-9]+"), (32, "[a-z2-7]+|[A-Z2-7]+"), (26, "[a-z]+|[A-Z]+"), (16, "[0-9a-f]+|[0-9A-F]+")):
        size = F.when(F.rlike(value, F.lit(f"^({own})$")), float(k)).otherwise(size)
    once = F.struct(F.filter(F.split(value, "", -1), lambda c: c != "").alias("chars"), size.alias("size"), F.length(value).cast("double").alias("n"))
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    pairs = lambda values, f: F.zip_with(F.slice(values, F.lit(1), F.size(values) - 1), F.slice(values, F.lit(2), F.size(values) - 1), f)

    def counted(one: Column) -> Column:
        chars, n, letters = one["chars"], one["n"], one["size"] == 26
        squares = add(F.transform(F.array_distinct(chars), lambda c: F.pow(F.size(F.filter(chars, lambda d: d == c)).cast("double"), F.lit(2.0))))
        codes = F.transform(chars, lambda c: F.instr(F.lit(_ALPHABET), c).cast("double"))
        kinds = F.transform(chars, lambda c: F.when(letters, F.when(F.instr(F.lit("AEIOUaeiou"), c) > 0, 1).otherwise(2)).otherwise(_class(c)))
        centred = _let(codes, lambda x: _let(add(x) / n, lambda mean: F.transform(x, lambda c: c - mean)))
        spread = lambda x: add(F.transform(x, lambda c: c * c))
        serial = _let(centred, lambda x: F.when(spread(x) > 0, add(pairs(x, lambda c, d: c * d)) / spread(x)).otherwise(F.lit(1.0)))
        changed = _let(kinds, lambda x: add(pairs(x, lambda c, d: F.when(c != d, 1.0).otherwise(0.0))))
        return F.struct(n.alias("n"), one["size"].alias("size"), letters.alias("letters"), squares.alias("squares"), serial.alias("serial"), changed.alias("changed"))

    def judged(c: Column) -> Column:
        text = F.when(c["letters"], SPOKEN).when(c["size"] <= 36, ONE_CASE).otherwise(CHANGES)
        found = _evidence(text, c["n"], c["size"], c["letters"], c["squares"], c["serial"], c["changed"])
        band = F.lit(0)
        for k, low in enumerate(BANDS[1:], 1):
            band = F.when(c["n"] >= low, k).otherwise(band)
        return F.struct(span["start"].alias("start"), span["end"].alias("end"), band.cast("int").alias("band"), F.least(F.floor(found * BINS), F.lit(LAST_BIN)).cast("int").alias("bin"))

    return _let(_let(once, counted), judged)


def candidates(text: Column) -> Column:
    """array<struct<start, end, band, bin>> of everything that the battery looks at."""
    return F.transform(_found(text, CANDIDATE), _tested)


def cuts(table: DataFrame) -> DataFrame:
    """(cuts): one row, an array with each band's least bin that is reported, from a table with a column `candidates`.

    Benjamini-Hochberg in each band: the least bin whose p-value, times all candidates of the band, is at most FALSE times the candidates from that bin on.
    Only numbers for each band and bin are gathered, of which there is a fixed number. Null where a band reports nothing.
    """
    each = table.select(F.explode(F.transform("candidates", lambda c: F.struct(c["band"].alias("band"), c["bin"].alias("bin")))).alias("c")).select("c.*")
    counted = each.groupBy("band", "bin").agg(F.count("*").alias("n")).groupBy("band").agg(F.collect_list(F.struct("bin", "n")).alias("bins"))
    total = F.aggregate("bins", F.lit(0).cast("long"), lambda s, b: s + b["n"])
    beyond = lambda b: F.aggregate(F.filter("bins", lambda o: o["bin"] >= b["bin"]), F.lit(0).cast("long"), lambda s, o: s + o["n"])
    good = F.filter("bins", lambda b: (b["bin"] > 0) & (total * F.exp(-b["bin"] / F.lit(float(BINS))) <= FALSE * beyond(b)))
    by_band = counted.select("band", F.array_min(F.transform(good, lambda b: b["bin"])).alias("cut"))
    return by_band.agg(F.array(*[F.max(F.when(F.col("band") == k, F.col("cut"))) for k in range(len(BANDS))]).alias("cuts"))


def _added(base: Column, found: Column, limits: Column) -> Column:
    """Candidates beyond their band's cut that no base span holds."""
    passed = F.filter(found, lambda c: F.coalesce(c["bin"] >= limits[c["band"]], F.lit(False)) & ~F.exists(base, lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"])))
    return _kind(passed, "random")


def _joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) for each row: arrays of (start, kind, end) in code points, end exclusive; kind is a place in KINDS.

    Null and empty texts have none; rows that repeat an id stay apart; other columns are not read; an empty table gives no rows. Texts are read once: what was found in them is written to the
    shared folder, the cuts are made from it, and applied to it.
    """
    ws = Workspace(docs.sparkSession, "secrets")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = ws.save(docs.select(F.col(id_col).cast("long").alias("id"), base_spans(text).alias("base"), candidates(text).alias("candidates")), "found")
    joined = found.crossJoin(F.broadcast(cuts(found)))  # one row
    return joined.select("id", "base", F.array_sort(F.concat("base", _added(F.col("base"), F.col("candidates"), F.col("cuts")))).alias("spans"))


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """text with each run of overlapping spans (sorted by start) replaced by the mask. The text is cut into parts of a bounded length, so that no piece is looked for from its beginning."""
    zero = F.lit(0).cast("long")
    ends = lambda s: _running(F.transform(s, lambda x: x["end"]), zero, lambda x, y: F.greatest(x, y))  # noqa: E731  # how far all before it reach
    fresh_ones = lambda s, e: F.filter(F.zip_with(s, e, lambda x, at: F.struct(at.alias("from"), x["start"].alias("to"))), lambda x: x["to"] >= x["from"])
    last = lambda s: F.aggregate(s, zero, lambda m, x: F.greatest(m, x["end"]))
    gaps = _let(spans, lambda s: F.concat(_let(ends(s), lambda e: fresh_ones(s, e)), F.array(F.struct(last(s).alias("from"), F.length(text).cast("long").alias("to")))))
    parts = F.transform(F.sequence(zero, F.floor(F.length(text) / PART)), lambda j: F.substring(text, (j * PART + 1).cast("int"), F.lit(PART)))

    def piece(all_parts: Column, gap: Column) -> Column:
        first, stop = F.floor(gap["from"] / PART), F.floor((gap["to"] - 1) / PART)
        inside = lambda j: _let(F.greatest(gap["from"] - j * PART, zero), lambda a: F.substring(all_parts[j.cast("int")], (a + 1).cast("int"), (F.least(gap["to"] - j * PART, F.lit(PART).cast("long")) - a).cast("int")))
        return F.when(gap["to"] > gap["from"], F.array_join(F.transform(F.sequence(first, stop), inside), "")).otherwise(F.lit(""))

    return _let(parts, lambda p: F.array_join(F.transform(gaps, lambda g: piece(p, g)), mask))


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[secret]", length_col: str | None = None) -> DataFrame:
    """docs with every span of scan() replaced by the mask in the text; spans that overlap become one mask. Other columns, whatever their names, and rows without secrets stay as they are.

    A null text stays null. length_col, if given, is set to the new text's length in rows that change. An empty table gives no rows.
    """
    names = docs.columns
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own, limits = fresh(names, "_spans"), fresh(names, "_cuts")
    cut = cuts(docs.select(candidates(text).alias("candidates"))).withColumnRenamed("cuts", limits)
    both = F.struct(base_spans(text).alias("base"), candidates(text).alias("more"))
    found = _let(both, lambda x: F.array_sort(F.concat(x["base"], _added(x["base"], x["more"], F.col(limits)))))
    out = docs.crossJoin(F.broadcast(cut)).withColumn(own, found).withColumn(own, F.when(F.size(own) > 0, _masked(text, F.col(own), mask)))  # one row of cuts
    new = {text_col: F.coalesce(own, F.col(f"`{text_col}`"))}
    if length_col:
        new[length_col] = F.when(F.col(own).isNotNull(), F.length(own).cast(docs.schema[length_col].dataType)).otherwise(F.col(f"`{length_col}`"))
    return out.select(*[(new[c] if c in new else F.col(f"`{c}`")).alias(c) for c in names])


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: the fixed patterns, and what the battery adds."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), n("assign"), n("access"), n("hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
