"""Secrets by known forms and by a battery of randomness tests, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubitgrid.llm.spans import let, matches, running
from cubitgrid.plans.tables import Tables

#: Fixed patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
#: Runs are maximal and a match can't begin inside a longer one, so that the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

#: Strings that are tested: whole runs of letters of codes, and their parts between separators.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{14,}={0,2}"
SEPARATOR = "[+/_-]"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Letters of each code in the order of their values; upper case is folded where a code has one case.
LETTERS = {"hex": DIGITS + "abcdef", "base32": UPPER + "234567", "base36": DIGITS + LOWER, "base62": UPPER + LOWER + DIGITS, "base64": UPPER + LOWER + DIGITS + "+/"}
LEAST_BITS = 80
#: A string under this chance is never taken for random, whatever its class allows.
LEAST_CHANCE = 0.01
BINS = 100
#: Strings whose chance is at least this square count as random when a class's random strings are estimated.
SURELY = 50


def two_sided(z: Column) -> Column:
    """Tail of the normal law beyond |z| on both sides, by a rational approximation good to 1e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.greatest(poly * F.exp(-x * x), F.lit(1e-15))


def _encoding(s: Column) -> Column:
    """The narrowest code that a string may be written in; null for numbers and for letters of one case or with a
    capital in front alone, which are words."""
    return (
        F.when(s.rlike("^[0-9]+$") | s.rlike("^[A-Z]?[a-z]+$") | s.rlike("^[A-Z]+$"), F.lit(None))
        .when(s.rlike("^[0-9a-f]+$") | s.rlike("^[0-9A-F]+$"), "hex")
        .when(s.rlike("^[A-Z2-7]+$"), "base32")
        .when(s.rlike("^[0-9a-z]+$") | s.rlike("^[0-9A-Z]+$"), "base36")
        .when(s.rlike("^[A-Za-z0-9]+$") & (s.rlike("[0-9]") | s.rlike("[a-z].*[A-Z]")), "base62")
        .when(s.rlike(SEPARATOR) & s.rlike("[a-z]") & s.rlike("[A-Z]") & s.rlike("[0-9]"), "base64")
    )


def battery(value: Column) -> Column:
    """struct<encoding, length, p>: the chance that a random string of its code looks less random than this one.

    Uniformity of the alphabet (chi-squared, upper tail by the cube-root normal) and of its digits against its
    letters, runs above and below the alphabet's middle, and correlation of neighbours, added by Fisher's method.
    p is null where the string is in no code or holds under LEAST_BITS bits.
    """
    bare = F.regexp_replace(value, "=+$", "")

    def coded(b: Column) -> Column:
        encoding = _encoding(b)
        folded = F.when(encoding.isin("hex", "base36"), F.lower(b)).when(encoding == "base64", F.translate(b, "-_", "+/")).otherwise(b)
        alphabet = F.when(F.lit(False), "")
        for name, letters in LETTERS.items():
            alphabet = alphabet.when(encoding == name, letters)
        return F.struct(encoding.alias("encoding"), folded.alias("s"), alphabet.alias("a"), F.char_length(b).alias("n"))

    def with_codes(b: Column) -> Column:
        enough = b["n"] * F.log2(F.char_length(b["a"]).cast("double")) >= LEAST_BITS
        codes = F.transform(F.filter(F.split(F.when(enough, b["s"]), ""), lambda c: c != ""), lambda c: F.instr(b["a"], c) - 1)
        return F.struct(b["encoding"].alias("encoding"), F.char_length(b["a"]).cast("double").alias("k"), codes.alias("x"), b["n"].cast("double").alias("n"), F.regexp_count(b["s"], F.lit("[0-9]")).cast("double").alias("digits"), F.regexp_count(b["a"], F.lit("[0-9]")).cast("double").alias("of"))

    def tested(b: Column) -> Column:
        n, k, x = b["n"], b["k"], b["x"]
        counts = F.transform(F.array_distinct(x), lambda c: F.size(F.filter(x, lambda d: d == c)).cast("double"))
        chi = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c * c) * k / n - n
        df = k - 1
        cube = (F.cbrt(F.greatest(chi, F.lit(1e-9)) / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        p_chi = F.when(cube > 0, two_sided(cube) / 2).otherwise(1 - two_sided(cube) / 2)
        share = b["of"] / k
        p_digits = two_sided((b["digits"] - n * share) / F.sqrt(n * share * (1 - share)))
        high = F.transform(x, lambda c: (c >= k / 2).cast("int"))
        n1 = F.aggregate(high, F.lit(0.0), lambda acc, h: acc + h)
        n0 = n - n1
        turns = F.zip_with(F.slice(high, 1, F.size(high) - 1), F.slice(high, 2, F.size(high) - 1), lambda a, c: (a != c).cast("double"))
        runs = 1 + F.aggregate(turns, F.lit(0.0), lambda acc, t: acc + t)
        mean = 2 * n1 * n0 / n + 1
        var = F.greatest((mean - 1) * (mean - 2) / F.greatest(n - 1, F.lit(1.0)), F.lit(1e-9))
        p_runs = F.when(n1 * n0 == 0, F.lit(1e-15)).otherwise(two_sided((runs - mean) / F.sqrt(var)))
        mid = F.aggregate(x, F.lit(0.0), lambda acc, c: acc + c) / n
        spread = F.aggregate(x, F.lit(0.0), lambda acc, c: acc + (c - mid) * (c - mid))
        both = F.aggregate(F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, c: (a - mid) * (c - mid)), F.lit(0.0), lambda acc, c: acc + c)
        p_serial = F.when(spread <= 0, F.lit(1e-15)).otherwise(two_sided(both / F.greatest(spread, F.lit(1e-9)) * F.sqrt(n)))
        fisher = -(F.log(F.greatest(p_chi, F.lit(1e-15))) + F.log(p_digits) + F.log(p_runs) + F.log(p_serial))
        p = let(fisher, lambda f: F.exp(-f) * (1 + f + f * f / 2 + f * f * f / 6))
        return F.struct(b["encoding"].alias("encoding"), F.size(x).alias("length"), p.alias("p"))

    untested = F.struct(F.lit(None).cast("string").alias("encoding"), F.lit(0).alias("length"), F.lit(None).cast("double").alias("p"))
    return let(let(let(bare, coded), with_codes), lambda b: F.when(F.size(b["x"]) > 1, tested(b)).otherwise(untested))


def _class(t: Column) -> Column:
    """Strings of a code in classes of half an octave of length: short ones give the tests less power than long ones."""
    return F.concat_ws(":", t["encoding"], F.least(F.floor(2 * F.log2(t["length"].cast("double"))), F.lit(40)).cast("string"))


def _bin(t: Column) -> Column:
    return F.least(F.floor(F.sqrt(t["p"]) * BINS), F.lit(BINS - 1)).cast("int")


def candidates(text: Column) -> Column:
    """array<array<struct<start, end, whole, t>>>: for each run of a text itself and, where it has separators, its parts,
    with their tests; what is in no code is left out."""
    def tests(found: Column) -> Column:
        coded = F.filter(found, lambda c: _encoding(F.regexp_replace(c["text"], "=+$", "")).isNotNull())
        return F.filter(F.transform(coded, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["whole"].alias("whole"), battery(c["text"]).alias("t"))), lambda c: c["t"]["p"].isNotNull())

    def parts(m: Column) -> Column:
        whole = F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(True).alias("whole"), m["text"].alias("text"))

        def pieces(c: Column) -> Column:
            ends = running(F.transform(c, lambda p: F.char_length(p) + 1))
            each = let(ends, lambda e: F.transform(c, lambda p, i: F.struct((m["start"] + F.get(e, i) - 1 - F.char_length(p)).alias("start"), (m["start"] + F.get(e, i) - 1).alias("end"), F.lit(False).alias("whole"), p.alias("text"))))
            return F.concat(F.array(whole), F.filter(each, lambda p: F.char_length(p["text"]) >= 14))

        return tests(let(F.split(m["text"], SEPARATOR), lambda c: F.when(F.size(c) > 1, pieces(c)).otherwise(F.array(whole))))

    return F.filter(F.transform(matches(text, CANDIDATE), parts), lambda run: F.size(run) > 0)


def limit(counts: dict[int, int], rate: float) -> tuple[float, float]:
    """(limit, share): strings of a class whose chance is the limit or more are taken for random; of them, `share` are
    expected not to be. The limit is over 1 where no limit keeps that share within the rate.

    counts: strings by bin of the root of their chance. Random strings spread evenly over chances and others crowd at
    small ones, so those from SURELY on tell how many random ones there are, and so how many lie above any limit:
    what is above it besides them is false. The smallest limit that keeps the false share is taken, step by step. This
    rests on the tests' power: a class whose false strings reach SURELY too is taken for random with them.
    """
    above = [sum(n for b, n in counts.items() if b >= at) for at in range(BINS + 1)]
    random = above[SURELY] / (1 - (SURELY / BINS) ** 2)
    for at in range(round(LEAST_CHANCE**0.5 * BINS), BINS):
        if above[at] and (share := max(0.0, 1 - random * (1 - (at / BINS) ** 2) / above[at])) <= rate:
            return (at / BINS) ** 2, share
    return 2.0, 0.0


def limits(rows: DataFrame, rate: float) -> dict[str, tuple[float, float]]:
    """limit() of each class over the whole table; at most 6 codes times 41 lengths times BINS counts reach the driver."""
    each = rows.select(F.explode(F.flatten("candidates")).alias("c")).select("c.t")
    counts: dict[str, dict[int, int]] = {}
    for r in each.groupBy(_class(F.col("t")).alias("class"), _bin(F.col("t")).alias("bin")).count().collect():
        counts.setdefault(r["class"], {})[r["bin"]] = r["count"]
    return {k: limit(c, rate) for k, c in sorted(counts.items())}


def _of_kind(kind: int):
    return lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))


def tested(docs: DataFrame) -> DataFrame:
    """(doc_id, base, candidates): array<struct<start, kind, end>> of the base kinds, and the tests of all candidates."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    # the value's length is checked after matching, since a match that fails takes its text all the same
    kinds = [F.filter(matches(text, ASSIGN), lambda m: F.char_length(F.regexp_extract(m["text"], VALUE, 1)) >= 12), matches(text, ACCESS), matches(text, HEX)]
    base = F.concat(*[F.transform(spans, _of_kind(k)) for k, spans in enumerate(kinds)])
    return rows.select("doc_id", F.array_sort(base).alias("base"), candidates(text).alias("candidates"))


def find(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """(doc_id, base, found, n_tested, n_confirmed): base and found are array<struct<start, kind, end>> in code points,
    by start and kind.

    The base kinds assign, access and hex, and `random`: strings of a code's letters, of LEAST_BITS bits at least,
    that the battery does not tell from random ones and that lie in no base span. Their limits hold the share of
    false ones in each class of code and length, over the whole table, to the rate. n_tested strings were tested, in
    base spans too; n_confirmed base spans hold one that was taken for random. Null and empty texts have none; one row
    for each input row. Texts are scanned once; their spans are a table, which the limits come from.
    """
    tables = Tables(docs.sparkSession, "secrets")
    rows = tables.cut(tested(docs))
    over = {k: v for k, (v, _) in limits(rows, rate).items()}
    least = F.create_map(*[F.lit(x) for kv in over.items() for x in kv]) if over else F.lit(None).cast("map<string,double>")
    random = lambda run: F.filter(run, lambda c: F.coalesce(_bin(c["t"]) >= F.round(F.sqrt(F.try_element_at(least, _class(c["t"]))) * BINS), F.lit(False)))
    # a whole run that is taken stands for its parts
    taken = lambda cs: F.when(F.exists(cs, lambda c: c["whole"]), F.filter(cs, lambda c: c["whole"])).otherwise(cs)
    rows = rows.withColumn("random", F.flatten(F.transform("candidates", lambda run: let(random(run), taken))))
    added = F.filter("random", lambda c: ~F.exists("base", lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"])))
    confirmed = F.size(F.filter("base", lambda b: F.exists("random", lambda c: (c["start"] < b["end"]) & (b["start"] < c["end"]))))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", F.transform(added, _of_kind(3)))).alias("found"), F.size(F.flatten("candidates")).cast("bigint").alias("n_tested"), confirmed.cast("bigint").alias("n_confirmed"))


def report(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans, n_tested, n_confirmed)."""
    names = F.array(*map(F.lit, KINDS))
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("bigint")
    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.col("found")).alias("spans"), "n_tested", "n_confirmed")
