"""Secret scan, in DataFrame operations only: fixed patterns, then a randomness test battery for other tokens.

Base spans come from three patterns. Further candidates are runs of 20 or more token characters outside the base spans
that mix digits with letters. For the encoding that their characters suggest (hex, base32, alphanumeric, base64) three
tests of uniform randomness are made: chi-squared over cells of the alphabet, runs about its middle, and lag-one serial
correlation; Fisher's method combines their p-values.

A discovery is a token that looks more random than natural ones do. How random these look depends on encoding and
length, so every document gives, for each encoding and length band that has candidates, one natural token: a run of its
letters from a hashed place (token-like words left out), in the encoding's letters, ended by a number, of the band's
least length. The share of natural tokens that look at least as random is a candidate's p-value, and Benjamini and
Hochberg's procedure, over all candidates of the encoding and band, keeps the expected share of natural tokens
among those reported under ``RATE``. A token that the tests of randomness themselves reject (``FLOOR``) isn't reported
either. Ranks come from histograms, so nothing is sorted in one place. In a corpus of a few documents natural tokens
are too few to tell, and nothing is added.

Spans are running sums over the rows of a text's matches, so their cost is linear in these.

Positions are in code points, ends exclusive. Edge cases: null counts as empty; texts without matches have zero counts,
no spans and the digest of the empty string; very long texts and runs are scanned whole; rows that repeat a doc_id are
each scanned; a null doc_id is scanned as any other; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import read_table, row_key, text_of, written

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX, RUN = r"AKIA[A-Z0-9]+", r"[0-9a-f]{24,}", r"[A-Za-z0-9+/_=-]{20,}"
RATE, FLOOR = 0.05, 0.01
#: Alphabets in order of value; chi-squared cells are pieces of them.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
CELLS = {"hex": [4, 8, 10, 13, 16], "base32": [8, 16, 26, 32], "alnum": [13, 26, 39, 52, 62], "base64": [13, 26, 39, 52, 64]}
BINS = 32  # bins of the p-value histogram for each power of ten


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<kind, i, gap, token>> of a pattern's matches, gap the characters since the one before."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda f, b: F.struct(f.alias("token"), F.length(b).alias("gap")))
    rows = F.transform(pairs, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["token"].alias("token")))
    return F.when(F.rlike(text, F.lit(pattern)), rows).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,token:string>>"))


def _erfc(x: Column) -> Column:
    """For x >= 0, to 1.2e-7 (Chebyshev fit of Numerical Recipes)."""
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    return t * F.exp(-x * x + poly)


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), _erfc(F.abs(z) / 2**0.5))


def battery(tokens: DataFrame) -> DataFrame:
    """Add encoding, n and p, the combined p-value of uniform randomness, to rows with a ``token``. The encoding is
    inferred, and tokens that don't mix digits with letters are dropped, unless it is there."""
    t = F.regexp_replace("token", "=+$", "")
    d = tokens.withColumn("_t", F.when(F.rlike(t, F.lit("^[0-9A-F]+$")), F.lower(t)).otherwise(F.translate(t, "-_=", "+/+")))
    columns = [c for c in tokens.columns if c != "encoding"]
    if "encoding" not in tokens.columns:
        mixed = F.rlike("_t", F.lit("[0-9]")) & F.rlike("_t", F.lit("[A-Za-z]"))
        enc = F.when(F.rlike("_t", F.lit("^[0-9a-f]+$")), "hex").when(F.rlike("_t", F.lit("^[A-Z2-7]+$")), "base32").when(F.rlike("_t", F.lit("^[A-Za-z0-9]+$")), "alnum").otherwise("base64")
        d = d.where(mixed).withColumn("encoding", enc)
    d = d.withColumn("n", F.length("_t").cast("double"))

    def by(of: dict) -> Column:
        out = F.lit(None)
        for name, value in of.items():
            out = F.when(F.col("encoding") == name, value).otherwise(out)
        return out

    d = d.withColumn("_a", by({k: F.lit(v) for k, v in ALPHABETS.items()})).withColumn("_k", F.length("_a").cast("double"))
    d = d.withColumn("_v", F.transform(F.split("_t", ""), lambda c: F.call_function("instr", F.col("_a"), c) - 1))
    d = d.withColumn("_cells", by({k: F.array(*map(F.lit, v)) for k, v in CELLS.items()}))
    # Chi-squared, turned into a normal deviate (Wilson and Hilferty).
    low = F.concat(F.array(F.lit(0)), "_cells")
    counts = F.zip_with("_cells", F.slice(low, 1, F.size("_cells")), lambda hi, lo: F.struct((F.size(F.filter("_v", lambda v: (v >= lo) & (v < hi)))).cast("double").alias("o"), ((hi - lo) * F.col("n") / F.col("_k")).alias("e")))
    chi = F.aggregate(counts, F.lit(0.0), lambda a, c: a + (c["o"] - c["e"]) * (c["o"] - c["e"]) / c["e"])
    f = (F.size("_cells") - 1).cast("double")
    z = (F.pow(chi / f, F.lit(1 / 3)) - (1 - 2 / (9 * f))) / F.sqrt(2 / (9 * f))
    d = d.withColumn("_p1", F.greatest(F.lit(1e-30), F.when(z > 0, _erfc(z / 2**0.5) / 2).otherwise(1 - _erfc(-z / 2**0.5) / 2)))
    # Runs about the middle of the alphabet (Wald and Wolfowitz).
    d = d.withColumn("_h", F.transform("_v", lambda v: (v * 2 >= F.col("_k")).cast("int"))).withColumn("_n1", F.aggregate("_h", F.lit(0), lambda a, x: a + x).cast("double"))
    n0, n1 = F.col("n") - F.col("_n1"), F.col("_n1")
    next_of = lambda c: F.slice(c, 2, F.size(c) - 1)
    but_last = lambda c: F.slice(c, 1, F.size(c) - 1)
    runs = 1 + F.aggregate(F.zip_with(but_last(F.col("_h")), next_of(F.col("_h")), lambda a, b: (a != b).cast("int")), F.lit(0), lambda a, x: a + x)
    mean = 2 * n0 * n1 / F.col("n") + 1
    var = (mean - 1) * (mean - 2) / (F.col("n") - 1)
    d = d.withColumn("_p2", F.when(var > 0, F.greatest(F.lit(1e-30), _two_sided((runs - mean) / F.sqrt(F.greatest(var, F.lit(1e-9)))))).otherwise(F.lit(1e-30)))
    # Lag-one serial correlation.
    d = d.withColumn("_m", F.aggregate("_v", F.lit(0.0), lambda a, x: a + x) / F.col("n")).withColumn("_s", F.aggregate("_v", F.lit(0.0), lambda a, x: a + (x - F.col("_m")) * (x - F.col("_m"))))
    lag = F.aggregate(F.zip_with(but_last(F.col("_v")), next_of(F.col("_v")), lambda a, b: (a - F.col("_m")) * (b - F.col("_m"))), F.lit(0.0), lambda a, x: a + x)
    d = d.withColumn("_p3", F.when(F.col("_s") > 0, F.greatest(F.lit(1e-30), _two_sided((lag / F.greatest("_s", F.lit(1e-9)) + 1 / F.col("n")) * F.sqrt("n")))).otherwise(F.lit(1e-30)))
    x = -(F.log("_p1") + F.log("_p2") + F.log("_p3"))  # half of Fisher's statistic: chi-squared with six degrees
    return d.withColumn("p", F.greatest(F.lit(1e-30), F.least(F.lit(1.0), F.exp(-x) * (1 + x + x * x / 2)))).withColumn("least", F.least("_p1", "_p2", "_p3")).select(*columns, "encoding", "n", "p", "least")


def _band(n: Column) -> Column:
    return F.floor(F.log2(n)).cast("int")


def natural(docs: DataFrame, wanted: list[tuple[str, int]]) -> DataFrame:
    """(encoding, n, p, least) of a natural token of each text (row, t) for each wanted encoding and length band."""
    words = F.regexp_replace("t", rf"{ASSIGN}|{ACCESS}|{HEX}|{RUN}", " ")
    letters = {
        "hex": F.regexp_replace(F.lower(words), "[^0-9a-f]+", ""),
        "base32": F.regexp_replace(F.upper(words), "[^A-Z2-7]+", ""),
        "alnum": F.regexp_replace(words, "[^A-Za-z0-9]+", ""),
        "base64": F.regexp_replace(words, "[^A-Za-z0-9]+", ""),
    }
    rows = []
    for enc, band in wanted:
        n = max(20, 1 << band)
        s = letters[enc]
        number = F.lpad(F.pmod(F.xxhash64("row", F.lit(band)), F.lit(10000)).cast("string"), 4, "0")
        at = F.pmod(F.xxhash64("row", F.lit(enc), F.lit(band)), F.greatest(F.length(s) - n + 5, F.lit(1)).cast("long")).cast("int") + 1
        token = F.when(F.length(s) >= n, F.concat(s.substr(at, F.lit(n - 4)), F.translate(number, "0189", "2345") if enc == "base32" else number))
        rows.append(F.struct(F.lit(enc).alias("encoding"), token.alias("token")))
    tokens = docs.select(F.explode(F.array(*rows)).alias("x")).select("x.encoding", "x.token").where("token IS NOT NULL")
    return battery(tokens).select("encoding", "n", "p", "least")


def random_looking(tested: DataFrame, docs: DataFrame, rate: float = RATE, floor: float = FLOOR) -> DataFrame:
    """The rows of ``battery`` that look more random than natural tokens of the texts (row, t), at a false-discovery rate."""
    bins = lambda d: d.withColumn("band", _band(F.col("n"))).withColumn("bin", F.floor(-F.log10("p") * BINS))
    cand = bins(tested)
    wanted = sorted((r["encoding"], r["band"]) for r in cand.select("encoding", "band").distinct().collect())  # four encodings, a band for each power of two
    if not wanted:
        return tested
    null = bins(natural(docs, wanted)).groupBy("encoding", "band", "bin").agg(F.count("*").alias("r")).withColumn("c", F.lit(0).cast("long"))
    hist = cand.groupBy("encoding", "band", "bin").agg(F.count("*").alias("c")).withColumn("r", F.lit(0).cast("long"))  # a few hundred rows a band at most
    hist = hist.unionByName(null).groupBy("encoding", "band", "bin").agg(F.sum("c").alias("c"), F.sum("r").alias("r"))
    of = Window.partitionBy("encoding", "band")
    ranked = hist.select("encoding", "band", "bin", *[F.sum(x).over(of.orderBy("bin")).alias(x.upper()) for x in "cr"], F.sum("c").over(of).alias("m"), F.sum("r").over(of).alias("all"))
    ok = F.col("m") * (1 + F.col("R")) / (1 + F.col("all")) <= rate * F.col("C")
    cut = ranked.where(ok).groupBy("encoding", "band").agg(F.max("bin").alias("cut"))
    out = cand.join(F.broadcast(cut), ["encoding", "band"])  # one row an encoding and power of two
    return out.where((F.col("bin") <= F.col("cut")) & (F.col("p") >= floor) & (F.col("least") >= floor / 10)).select(*tested.columns)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, base, added): spans as array<struct<start, kind, stop>>, kind an index into ``KINDS``."""
    d = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row"), text_of(text_col).alias("t"))
    found = F.flatten(F.array(*(_matches(F.col("t"), p, k) for k, p in enumerate((ASSIGN, ACCESS, HEX, RUN)))))
    t = written(d.select("doc_id", "row", found.alias("m")), "matches")
    each = t.where(F.size("m") > 0).dropDuplicates(["row"]).select("row", F.explode("m").alias("x")).select("row", "x.*")
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("token")
    at = each.withColumn("stop", F.sum(F.col("gap") + size).over(so_far).cast("int")).withColumn("start", F.col("stop") - size)
    keep = F.when(F.col("kind") == 0, F.length(F.regexp_extract("token", ASSIGN, 2)) >= 6).when(F.col("kind") == 1, size >= 20).otherwise(True)
    spans = written(at.where(keep).select("row", "kind", "start", "stop", "token"), "spans")
    # A run is free if no base span that starts before its end stops after its start.
    run = F.col("kind") == 3
    before = Window.partitionBy("row").orderBy(F.when(run, F.col("stop") - 1).otherwise(F.col("start")), run).rowsBetween(Window.unboundedPreceding, 0)
    reach = spans.withColumn("reach", F.max(F.when(~run, F.col("stop"))).over(before))
    free = reach.where(run & (F.col("reach").isNull() | (F.col("reach") <= F.col("start")))).select("row", "start", "stop", "token")
    tested = written(battery(free), "battery")
    span = lambda d, kind: F.collect_list(F.struct("start", kind.alias("kind"), "stop")).alias(d)
    base = spans.where(~run).groupBy("row").agg(span("base", F.col("kind")))
    added = random_looking(tested, d.select("row", "t")).groupBy("row").agg(span("added", F.lit(3)))
    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    out = t.select("doc_id", "row").join(base, "row", "left").join(added, "row", "left")
    return out.select("doc_id", "row", F.array_sort(F.coalesce("base", none)).alias("base"), F.array_sort(F.coalesce("added", none)).alias("added"))


def written_out(spans: Column) -> Column:
    """kind:start:end of each span, by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(read_table(spark, sf_dir, "documents"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return got.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written_out(F.col("base")).cast("binary"), 256).alias("base_sha256"), written_out(F.concat("base", "added")).alias("spans"))
