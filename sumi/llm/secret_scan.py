"""Secret scans: fixed patterns plus sliding-window Shannon entropy, in DataFrame functions only.

`splits` of a text around a pattern and the matches themselves alternate, so summing their lengths gives every
match's place in code points without a Python function. Candidate strings are runs of key characters. Each is
scanned once with a window of fixed width, whose counts of characters are kept, five bits each, in a few whole
numbers: a step takes one character out and one in, and changes those two counts and the sum of n*log2(n) by them.
The largest entropy of any window is held against the limit of the candidate's character class (hex, letters of one
case, letters of both, one case with digits, mixed). A candidate that is as a whole of an allow-listed shape (UUIDs,
plain sequences, placeholders, one repeated block, numbers) is suppressed, and so is what a base span covers already.

Edge cases: null and empty texts have no spans; equal starts are ordered as kinds are listed; repeated rows give
repeated rows; very long texts are scanned whole, in one pass for each pattern.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Runs of key characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KINDS = ("assign", "access", "hex", "entropy")
MIN_VALUE = 12
WINDOW = 20
#: Bits in any window of WINDOW characters from which a candidate of that class is a secret; the most is log2(20) = 4.32.
LIMITS = {"hex": 3.1, "one_case_letters": 3.9, "letters": 4.0, "one_case": 3.6, "mixed": 3.8}
#: Shapes of whole candidates that are no secrets.
ALLOW = r"^(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|(?i:(?:abcdefghijklmnopqrstuvwxyz|0123456789|1234567890|[-_=+/])+)|(?i:[a-z_-]*(?:example|placeholder|changeme|x{6})[a-z_-]*)|(.{1,8})\1{2,}|[0-9/_=+-]+)$"
MASK = "[SECRET]"
SPAN = "struct<start:bigint,kind:int,end:bigint,hit:string,value:string>"


def _spans(text: Column, kind: int, pattern: str, group: int = 0) -> Column:
    """All matches as (start, kind, end, match, group), left to right, code points."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    zipped = F.zip_with(F.arrays_zip(hits.alias("hit"), values.alias("value")), F.slice(gaps, 1, F.size(hits)), lambda m, gap: F.struct(m["hit"].alias("hit"), m["value"].alias("value"), F.length(gap).alias("gap")))
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def add(acc, m):
        start = acc["at"] + m["gap"]
        end = start + F.length(m["hit"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m["hit"].alias("hit"), m["value"].alias("value")).cast(SPAN)
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    found = F.aggregate(zipped, empty, add, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


#: A lane holds the counts of LANE characters, COUNT_BITS bits each.
COUNT_BITS, LANE = 5, 12


def window_entropy(text: Column, width: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of any window of `width` characters, 31 at most; 0 for shorter texts.
    Characters outside ALPHABET count as one."""
    if not 0 < width < 1 << COUNT_BITS:
        raise ValueError(f"width must be below {1 << COUNT_BITS}")
    terms = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(width + 2)))
    n_lanes = -(-(len(ALPHABET) + 1) // LANE)
    codes = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.instr(F.lit(ALPHABET), c))
    # each step's character and the one that leaves the window, -1 where none does
    steps = F.arrays_zip(codes.alias("came"), F.slice(F.concat(F.array_repeat(F.lit(-1), width), codes), 1, F.size(codes)).alias("left"))

    def at(code):
        return (code % LANE * COUNT_BITS).cast("int")

    def count(lanes, code):
        lane = F.element_at(lanes, F.floor(code / LANE).cast("int") + 1)
        return F.call_function("shiftright", lane, at(code)).bitwiseAND((1 << COUNT_BITS) - 1)

    def changed(lanes, code, by):
        one = F.call_function("shiftleft", F.lit(by).cast("long"), at(code))
        return F.transform(lanes, lambda lane, k: F.when(k == F.floor(code / LANE), lane + one).otherwise(lane))

    def term(n):
        return F.element_at(terms, (n + 1).cast("int"))

    def step(acc, s):
        full = s["left"] >= 0
        was = count(acc["lanes"], F.greatest(s["left"], F.lit(0)))
        lanes = F.when(full, changed(acc["lanes"], s["left"], -1)).otherwise(acc["lanes"])
        gone = acc["sum"] + F.when(full, term(was - 1) - term(was)).otherwise(0.0)
        now = count(acc["lanes"], s["came"]) - (full & (s["left"] == s["came"])).cast("long")
        total = gone + term(now + 1) - term(now)
        bits = F.when(acc["n"] + 1 >= width, math.log2(width) - total / width).otherwise(0.0)
        return F.struct((acc["n"] + 1).alias("n"), changed(lanes, s["came"], 1).alias("lanes"), total.alias("sum"), F.greatest(acc["best"], bits).alias("best"))

    start = F.struct(F.lit(0).alias("n"), F.array_repeat(F.lit(0).cast("long"), n_lanes).alias("lanes"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
    return F.aggregate(steps, start, step, lambda acc: acc["best"])


def scan(docs: DataFrame, allow: str = ALLOW, limits: dict[str, float] = LIMITS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and `found`, all spans by start, then kind: array of (start, kind, end)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*keep, text.alias("__text"))
    text = F.col("__text")
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    rows = rows.select(
        *keep,
        F.filter(_spans(text, 0, ASSIGN, 1), lambda s: F.length(s["value"]) >= MIN_VALUE).alias("assign"),
        _spans(text, 1, ACCESS).alias("access"),
        _spans(text, 2, HEX).alias("hex"),
        F.filter(_spans(text, 3, CANDIDATE), lambda s: ~s["hit"].rlike(allow)).alias("candidates"),
    )
    rows = rows.select(*keep, F.array_sort(F.concat(bare(F.col("assign")), bare(F.col("access")), bare(F.col("hex")))).alias("base"), "candidates")

    def limit(hit):
        one_case, letters = ~(hit.rlike("[A-Z]") & hit.rlike("[a-z]")), ~hit.rlike("[0-9]")
        kinds = F.when(hit.rlike("^[0-9a-fA-F]+$"), limits["hex"]).when(letters & one_case, limits["one_case_letters"]).when(letters, limits["letters"])
        return kinds.when(one_case, limits["one_case"]).otherwise(limits["mixed"])

    secret = F.filter(
        F.col("candidates"),
        lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])) & (window_entropy(s["hit"]) >= limit(s["hit"])),
    )
    return rows.select(*keep, F.array_sort(F.concat("base", bare(secret))).alias("found"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of each base kind, the digest of the base spans, and all spans as text."""
    found = scan(docs)
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.filter("found", lambda s: s["kind"] < 3)).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        count(3).alias("n_entropy"),
    )


def redact(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """The same rows and columns; every span in `text` is replaced by `mask`, overlapping ones by one."""
    names = docs.columns
    rows = scan(docs.withColumn("__whole", F.struct(*names)), keep=("__whole",))
    text = F.col("__whole")["text"]

    def add(acc, s):
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"]).alias("out"))

    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    masked = F.aggregate("found", empty, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    masked = F.when(F.size("found") > 0, masked).otherwise(text)
    return rows.select(*((masked.alias(n) if n == "text" else F.col("__whole")[n].alias(n)) for n in names))
