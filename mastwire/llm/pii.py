"""Personal data in built-in SQL functions only: patterns propose, checksums confirm, context scores.

Every kind goes the same way. Its pattern splits the text into gaps and matches, so that places
come from summed lengths and no match is looked for twice; a rule (range, digit count, Luhn,
mod-97) confirms a match, and words beside it move its score. The four base kinds are kept by
their rule alone; the further kinds must also reach ``min_score``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths are summed in blocks of this many matches: the work stays linear in long texts.
BLOCK = 64
NEAR = 48
MIN_SCORE = 0.6


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check; from the right, every second digit doubles."""
    places = F.sequence(F.lit(1), F.length(digits))
    total = F.aggregate(
        F.transform(places, lambda i: F.when(
            (F.length(digits) - i) % 2 == 0, F.substr(digits, i, F.lit(1)).cast("int")
        ).otherwise(F.substr(digits, i, F.lit(1)).cast("int") * 2)),
        F.lit(0), lambda s, d: s + d - F.when(d > 9, 9).otherwise(0),
    )
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number leaves 1 modulo 97, its first four signs moved to the end."""
    plain = F.upper(F.replace(account, F.lit(" "), F.lit("")))
    turned = F.concat(F.substr(plain, F.lit(5), F.length(plain)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        sign = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(sign < 58, (rest * 10 + sign - 48) % 97).otherwise((rest * 100 + sign - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _count(low: int, high: int) -> Callable[[Column], Column]:
    return lambda m: F.length(_digits(m)).between(low, high)


_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # a text without it has no match
    rule: Callable[[Column], Column]
    mark: str
    start: float = 0.5  # score of a confirmed match without context
    words: str = ""  # beside a match, they raise the score
    against: str = ""  # before a match, they lower it


# Possessive repeats and starts at the edge of a run (or where the last match ended) find the same
# matches as the plain patterns and never rescan a long run.
BASE = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         lambda m: F.lit(True), "<EMAIL>"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]",
         lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"), "<IP>"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9][ -]?[0-9]",
         lambda m: F.when(_count(13, 19)(m), luhn(_digits(m))).otherwise(False), "<CARD>"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", _count(9, 15), "<PHONE>"),
)
FURTHER = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
         "[A-Z]{2}[0-9]{2}", mod97, "<IBAN>", start=0.7, words="iban|account|konto|compte|cuenta|bank"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "[0-9]-[0-9]",
         lambda m: F.lit(True), "<SSN>", start=0.4, words="ssn|social|security|tax", against="order|part|model|isbn"),
    Kind("secret", r"(?<![A-Za-z0-9])[A-Fa-f0-9]{32,64}(?![A-Za-z0-9])", "[A-Fa-f0-9]{32}",
         lambda m: m.rlike("[0-9]") & m.rlike("[A-Fa-f]"), "<SECRET>", start=0.3,
         words="token|secret|passw|api.?key|credential|bearer", against="sha|md5|commit|checksum|digest"),
)


def _proposals(text: Column, kind: Kind) -> Column:
    """Matches of a kind in order: gap before, length, text, what stands beside, confirmed or not."""
    pattern = F.lit(kind.pattern)
    empty = F.from_json(F.lit("[]"), "array<struct<gap:int,len:int,ok:boolean>>")
    gaps = F.split(text, kind.pattern, -1)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))

    def judged(m: Column, i: Column) -> Column:
        before, after = F.get(gaps, i), F.get(gaps, i + 1)
        return F.struct(
            F.length(before).alias("gap"), F.length(m).alias("len"), _confirmed(kind, m, before, after).alias("ok")
        )

    return F.when(text.rlike(kind.hint), F.transform(matches, judged)).otherwise(empty)


def _confirmed(kind: Kind, m: Column, before: Column, after: Column) -> Column:
    held = F.coalesce(kind.rule(m), F.lit(False))
    if kind in BASE:
        return held
    return held & (score(kind, before, after) >= MIN_SCORE)


def score(kind: Kind, before: Column, after: Column) -> Column:
    """Score of a confirmed match: its kind's start, 0.4 more by words beside it, 0.4 less by words before it."""
    ahead = F.lower(F.right(before, F.lit(NEAR)))
    beside = F.concat(ahead, F.lit(" "), F.lower(F.left(after, F.lit(NEAR))))
    out = F.lit(kind.start)
    if kind.words:
        out = out + F.when(beside.rlike(kind.words), 0.4).otherwise(0.0)
    if kind.against:
        out = out - F.when(ahead.rlike(kind.against), 0.4).otherwise(0.0)
    return out


def _placed(proposals: Column) -> Column:
    """(start, end) of the confirmed proposals, counted in code points, by two levels of sums."""
    span = lambda x: x["gap"] + x["len"]
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(proposals) - 1) / BLOCK).cast("int")),
        lambda b: F.slice(proposals, b * BLOCK + 1, F.lit(BLOCK)),
    )
    nowhere = F.from_json(F.lit("[]"), "array<int>")
    firsts = F.aggregate(
        F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + span(x))),
        F.struct(nowhere.alias("at"), F.lit(0).alias("sum")),
        lambda s, n: F.struct(F.array_append(s["at"], s["sum"]).alias("at"), (s["sum"] + n).alias("sum")),
    )["at"]

    def inside(block: Column, first: Column) -> Column:
        ends = F.aggregate(
            block, F.struct(nowhere.alias("at"), first.alias("sum")),
            lambda s, x: F.struct(F.array_append(s["at"], s["sum"] + span(x)).alias("at"), (s["sum"] + span(x)).alias("sum")),
        )["at"]
        return F.zip_with(block, ends, lambda x, e: F.struct((e - x["len"]).alias("start"), e.alias("end"), x["ok"].alias("ok")))

    return F.filter(F.flatten(F.zip_with(blocks, firsts, inside)), lambda x: x["ok"])


def _listed(kind: str, spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def find(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` the counts, the digest of the base spans and the list of all spans.

    Null text is an empty one: no span. Repeated rows and null ids stay as they are; columns
    besides doc_id and text are not read. Texts of any length are searched whole.
    """
    kinds = BASE + FURTHER
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = found.select("doc_id", *(_proposals(F.col("text"), k).alias(k.name) for k in kinds))
    nothing = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,ok:boolean>>")
    found = found.select("doc_id", *(
        F.when(F.size(k.name) > 0, _placed(F.col(k.name))).otherwise(nothing).alias(k.name) for k in kinds))
    listed = {k.name: F.nullif(_listed(k.name, F.col(k.name)), F.lit("")) for k in kinds}
    return found.select(
        "doc_id",
        *(F.size(k.name).cast("long").alias(f"n_{k.name}") for k in BASE),
        F.sha2(F.concat_ws(",", *(listed[k.name] for k in BASE)), 256).alias("base_sha256"),
        F.concat_ws(",", *(listed[k.name] for k in kinds)).alias("spans"),
        *(F.size(k.name).cast("long").alias(f"n_{k.name}") for k in FURTHER),
    )


def _one(text: Column, kind: Kind) -> Column:
    """The text with the confirmed spans of one kind replaced by its mark."""
    gaps = F.split(text, kind.pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    kept = F.transform(matches, lambda m, i: F.concat(
        F.get(gaps, i),
        F.when(_confirmed(kind, m, F.get(gaps, i), F.get(gaps, i + 1)), F.lit(kind.mark)).otherwise(m)))
    return F.when(text.rlike(kind.hint), F.concat(F.array_join(kept, ""), F.element_at(gaps, -1))).otherwise(text)


def _marked(mark: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("less"), F.lit(mark).alias("mark"))


def _whole(docs: DataFrame) -> DataFrame:
    """``docs`` with the confirmed spans of all kinds merged where they overlap, each replaced once by its first kind's mark."""
    kinds, text = FURTHER + BASE, F.col("text")
    nothing = F.from_json(F.lit("[]"), "array<struct<start:int,less:int,mark:string>>")
    nowhere = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,ok:boolean>>")
    found = docs.withColumns({f"__{k.name}": _proposals(F.coalesce("text", F.lit("")), k) for k in kinds})
    found = found.withColumns({f"__{k.name}": F.when(F.size(f"__{k.name}") > 0, _placed(F.col(f"__{k.name}"))).otherwise(nowhere) for k in kinds})
    found = found.withColumn("__spans", F.array_sort(F.concat(nothing, *(F.transform(f"__{k.name}", _marked(k.mark)) for k in kinds))))

    def step(s: Column, x: Column) -> Column:
        gap = F.concat(F.substr(text, s["at"] + 1, x["start"] - s["at"]), x["mark"])
        return F.struct(F.when(x["start"] >= s["at"], F.array_append(s["out"], gap)).otherwise(s["out"]).alias("out"),
                        F.greatest(s["at"], -x["less"]).alias("at"))

    start = F.struct(F.from_json(F.lit("[]"), "array<string>").alias("out"), F.lit(0).alias("at"))
    merged = F.aggregate(
        "__spans", start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substr(text, s["at"] + 1, F.length(text))))
    return found.withColumn("text", F.when(F.size("__spans") > 0, merged).otherwise(text)).select(docs.columns)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of ``text`` replaced and ``n_chars`` (where present) counted anew.

    All spans are those of the text as it came. What only their removal lets match is replaced
    after them; there the further kinds go first, since a base kind may match a part of them.
    Null text stays null.
    """
    out = _whole(docs)
    for kind in FURTHER + BASE:
        out = out.withColumn("text", _one(F.col("text"), kind))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
