"""Secret scans in DataFrame functions: three patterns, and windows of high Shannon entropy.

Positions come from one rule: a text split by a pattern gives the gaps, extracting the pattern gives the matches, and
both take turns. Offsets count code points; ends are exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: the kinds in their order, their patterns, the group and its least length.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Equal to matching [0-9a-f]+ and dropping what is shorter than 32: a run is matched whole either way.
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Candidates of the entropy scan: runs of token characters with a letter and a digit.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: The code of the first of a candidate's characters, and characters that are looked at in one go.
FIRST, BLOCK = ord("+"), 4096
#: Least entropy in bits of some window, by class of character: hexadecimal digits, alphanumeric, with signs.
LEAST = {"hex": 3.1, "alnum": 3.8, "signs": 3.9}
#: Candidates that are no secrets: UUIDs, dates and times, digits in groups, placeholders, and what follows a digest's name.
ALLOWED = r"^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$|^\d{4}-\d\d-\d\d|^[\d+/_=-]+$|(?i)example|placeholder|x{6}|changeme|dummy"
ALLOWED_BEFORE = r"(?i)(?:sha-?(?:1|224|256|384|512)|md5|crc|commit|checksum|digest|integrity)['\"]?\x20*[:=-]?\x20*['\"]?$"


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with ``value`` computed once however often the body, or a lambda inside it, uses it."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running sums or maxima of an array, by doubling: n log n work, where appending item by item would copy n * n."""

    def by_doubling(own: Column) -> Column:
        rounds = F.ceil(F.log2(F.size(own).cast("double"))).cast("int")
        far = F.when(F.size(own) > 1, F.transform(F.sequence(F.lit(0), rounds - 1), lambda k: F.pow(F.lit(2.0), k).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(far, own, lambda acc, d: F.transform(acc, lambda x, i: F.when(i >= d, join(x, acc[i - d])).otherwise(x)))

    return _once(values, by_doubling)


def _turns(text: Column, pattern: str, group: int, keep: Callable[[Column, Column], Column], kind: int) -> Column:
    """array<struct<start, kind, end>> of the matches of ``pattern`` for which keep(group's text, gap before) holds."""
    rx = F.lit(pattern)
    turns = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, rx, F.lit(0)).alias("hit"), F.regexp_extract_all(text, rx, F.lit(group)).alias("part"))
    length = lambda hit: F.coalesce(F.char_length(hit), F.lit(0))

    def spans(rows: Column) -> Column:
        ends = _running(F.transform(rows, lambda r: F.char_length(r["gap"]) + length(r["hit"])), lambda x, before: x + before)
        span = lambda r, end: F.struct((end - length(r["hit"])).alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.filter(F.zip_with(rows, ends, lambda r, end: F.when(r["hit"].isNotNull() & keep(r["part"], r["gap"]), span(r, end))), lambda s: s.isNotNull())

    return F.when(text.rlike(pattern), _once(turns, spans)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """The greatest Shannon entropy, in bits a character, of a window sliding over ``text``; null if it is shorter.

    ``text`` consists of candidates' characters. The window's counts are kept, five bits each in seven numbers: a step
    adds the character that enters, takes away the one that leaves, and changes the sum of c * log2(c) by these two alone.
    The sum is a whole number of 2**-40, so that nothing drifts. Work is linear; a long text goes in blocks that overlap
    by a window less one character, so that memory stays small.
    """
    if not 1 < window < 32:
        raise ValueError("a window has 2 to 31 characters")
    terms = [round(c * math.log2(c) * 2**40) if c else 0 for c in range(window + 1)]
    gain = F.array(*[F.lit(more - less).cast("long") for less, more in zip(terms, terms[1:], strict=False)])
    one = F.lit(1).cast("long")
    shift = lambda name, value, bits: F.call_function(name, value, bits)
    place = lambda code: F.struct(F.floor(code / 12).cast("int").alias("word"), (code % 12 * 5).alias("bit"))

    def least_sum(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            came, left = codes[i], F.when(i >= window, codes[i - window])
            count = lambda c: shift("shiftright", acc["counts"][c["word"]], c["bit"]).bitwiseAND(F.lit(31)).cast("int")
            unit = lambda c, k: F.when(c["word"] == k, shift("shiftleft", one, c["bit"])).otherwise(F.lit(0).cast("long"))
            same = came == left
            total = F.when(same, acc["sum"]).otherwise(acc["sum"] + gain[count(came)] - F.when(left.isNull(), F.lit(0).cast("long")).otherwise(gain[count(left) - 1]))
            counts = F.when(same, acc["counts"]).otherwise(F.transform(acc["counts"], lambda w, k: w + unit(came, k) - unit(left, k)))
            return F.struct(counts.alias("counts"), total.alias("sum"), F.when(i >= window, F.least(acc["least"], acc["sum"])).alias("least"))

        zeros = F.array_repeat(F.lit(0).cast("long"), 7)
        start = F.struct(zeros.alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("least"))
        return F.when(F.size(codes) >= window, F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda acc: F.least(acc["least"], acc["sum"])))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{BLOCK + window - 1}}})).{{1,{BLOCK}}}"), F.lit(1))
    least = F.array_min(F.transform(blocks, lambda b: _once(F.transform(F.split(b, ""), lambda ch: place(F.ascii(ch) - FIRST)), least_sum)))
    return F.lit(math.log2(window)) - least / F.lit(float(window * 2**40))


def _random(part: Column, gap: Column) -> Column:
    """Whether a candidate is random by its class's threshold and no allow-list names it."""
    letter_digit = part.rlike(r"[0-9]") & part.rlike(r"[A-Za-z]")
    least = F.when(part.rlike(r"^[0-9A-Fa-f]+$"), LEAST["hex"]).when(part.rlike(r"^[0-9A-Za-z]+$"), LEAST["alnum"]).otherwise(LEAST["signs"])
    allowed = part.rlike(ALLOWED) | F.right(gap, F.lit(24)).rlike(ALLOWED_BEFORE)
    return F.when(~letter_digit, F.lit(False)).when(allowed, F.lit(False)).otherwise(window_entropy(part) >= least)


def secret_spans(docs: DataFrame, text_col: str = "text", out: str = "secret_spans") -> DataFrame:
    """Adds ``out``: array<struct<start, kind, end>>, by start and then kind; kind indexes KINDS.

    Kinds 0 to 2 are the patterns, each with its own leftmost matches that don't overlap; kind 3 the entropy scan, which
    adds spans and takes none away. A null or empty text has no spans. Rows are treated one by one: repeated rows, null
    ids and further columns change nothing, and an empty table stays empty. Matches that begin at one place (ties) stand
    in the order of KINDS. A very long text costs what its characters do (n log n in its matches); none is cut short.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    long_enough = lambda n: lambda part, gap: F.char_length(part) >= n
    kinds = [
        _turns(text, ASSIGN, 2, long_enough(8), 0),
        _turns(text, ACCESS, 0, long_enough(16), 1),
        _turns(text, HEX, 0, long_enough(32), 2),
        _turns(text, CANDIDATE, 0, _random, 3),
    ]
    return docs.withColumn(out, F.array_sort(F.concat(*kinds)))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _slice(blocks: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to ``end`` of a text that was cut into blocks; work by the blocks touched, not from the text's start."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    at = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
    head = F.substring(at(first), start % BLOCK + 1, F.lit(BLOCK))
    between = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    return F.when(first == last, F.substring(at(first), start % BLOCK + 1, end - start)).otherwise(F.concat(head, between, F.substring(at(last), F.lit(1), end % BLOCK)))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; spans that overlap or touch become one mark. Other texts stay as they are.

    Null, empty and repeated rows are as in ``secret_spans``; so is work by the length of a text.
    """
    spans = "_secret_spans"
    while spans in docs.columns:
        spans += "_"
    text = F.col(text_col)

    def clean(v: Column) -> Column:
        reach = _running(F.transform(v["spans"], lambda s: s["end"]), F.greatest)
        # Each span with the furthest end before it; one that begins beyond that end begins a mark.
        pairs = F.zip_with(v["spans"], F.concat(F.array(F.lit(-1)), F.slice(reach, 1, F.size(v["spans"]) - 1)), lambda s, before: F.struct(before.alias("before"), s["start"].alias("start")))
        marked = F.transform(F.filter(pairs, lambda p: p["start"] > p["before"]), lambda p: F.concat(_slice(v["blocks"], F.greatest(p["before"], F.lit(0)), p["start"]), F.lit(mark)))
        return F.concat(F.array_join(marked, ""), _slice(v["blocks"], F.array_max(F.transform(v["spans"], lambda s: s["end"])), v["length"]))

    cut = F.struct(F.col(spans).alias("spans"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks"), F.char_length(text).alias("length"))
    return secret_spans(docs, text_col, spans).withColumn(text_col, F.when(F.size(spans) > 0, _once(cut, clean)).otherwise(text)).drop(spans)


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    spans = F.col("secret_spans")
    n = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(joined(F.filter(spans, lambda s: s["kind"] < 3)), 256).alias("base_sha256"), joined(spans).alias("spans"),
    )
