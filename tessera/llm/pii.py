"""Personal data: patterns propose spans, checksums confirm them, context words move their score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import whole

# The patterns below say what [..]+ runs with backtracking would say, in time linear in the text: runs are possessive
# where what follows can't be part of them, and start where a run starts or where the last match ended (\G), as a run
# that fails at its start fails at every later place in it.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9_])",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+",
}
#: Kinds whose spans all stay; those of the others need LEAST_SCORE.
BASE = ("email", "ip", "card", "phone")
#: Score in hundredths before context; with a checksum or a range check that held it is high from the start.
PRIOR = {"email": 90, "ip": 60, "card": 80, "phone": 60, "iban": 80, "secret": 45}
#: Words near a span that raise its score, by kind, and words that lower any score.
CONTEXT = {
    "email": ["mail", "e-mail", "email", "contact", "kontakt", "correo", "courriel"],
    "ip": ["ip", "address", "server", "host", "adresse", "servidor", "serveur"],
    "card": ["card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"],
    "phone": ["phone", "tel", "call", "mobile", "fax", "telefon", "tél", "teléfono"],
    "iban": ["iban", "bank", "account", "konto", "compte", "cuenta"],
    "secret": ["token", "key", "secret", "passw", "pwd", "auth", "bearer", "credential"],
}
AGAINST = ["example", "version", "test", "dummy", "sample", "isbn"]
#: Code points before a span in which context words count, hundredths that one changes, and the score that a span of
#: another kind than BASE needs.
NEAR, STEP, LEAST_SCORE = 40, 10, 0.5

SPAN = "struct<kind:string,start:bigint,end:bigint,value:string,score:double>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn."""
    last = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, last - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), last - 1), F.lit(0), lambda a, i: a + part(i))
    return (last > 0) & (total % 10 == 0)


def mod97(iban: Column) -> Column:
    """Whether a string of A-Z and 0-9, moved by four places and read with A = 10 to Z = 35, leaves 1 modulo 97."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(a: Column, i: Column) -> Column:
        c = F.substring(moved, i, F.lit(1))
        code = F.ascii(c)
        return F.when(code >= 65, (a * 100 + code - 55) % 97).otherwise((a * 10 + code - 48) % 97)

    rest = F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step)
    return F.length(iban).between(15, 34) & (rest == 1)


def _holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        digits = F.regexp_replace(m, r"[\x20-]", "")
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(m, r"\x20", ""))
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


#: A cheap test on the whole text; where it fails the pattern can't match.
_ASKS = {
    "email": lambda t: F.instr(t, "@") > 0,
    "phone": lambda t: F.instr(t, "+") > 0,
}


def _score(kind: str, before: Column) -> Column:
    near = F.translate(before, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    up = [F.when(F.instr(near, w) > 0, 1).otherwise(0) for w in CONTEXT[kind]]
    down = [F.when(F.instr(near, w) > 0, 1).otherwise(0) for w in AGAINST]
    raw = F.lit(PRIOR[kind]) + STEP * (F.least(sum(up[1:], up[0]), F.lit(2)) - F.least(sum(down[1:], down[0]), F.lit(2)))
    return F.greatest(F.lit(0), F.least(F.lit(100), raw)).cast("double") / 100


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """One row per row of docs: id_col and, for each kind of PATTERNS, an array of spans (SPAN; places in code points,
    end exclusive), named like the kind.

    For each kind the leftmost matches that don't overlap are taken over the whole text; those that fail the kind's
    check go (ip: parts at most 255; card: 16 to 19 digits and Luhn; phone: 8 to 15 digits; iban: mod-97; secret: letters
    and digits), without a second try inside them. Words of CONTEXT in the NEAR code points before a span, from the last
    match of its kind on, raise its score, those of AGAINST lower it. Spans of the kinds of BASE stay whatever their
    score; of the others those under least_score go, so a long run of letters and digits is a secret only next to a word
    that says so.

    Only DataFrame functions are used and there is no shuffle. Null text counts as empty and gives empty arrays; null
    ids and repeated rows are kept as they are; other columns are ignored; an empty table gives an empty result. The
    work grows with a text's length and, for n matches, with n log n.
    """
    out = docs.select(docs[id_col].alias("id"), whole(docs[text_col]).alias("text"))
    none = F.array().cast("array<string>")
    for kind, pattern in PATTERNS.items():
        asked = _ASKS.get(kind)
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        out = out.withColumn(f"m_{kind}", F.when(asked(F.col("text")), found).otherwise(none) if asked else found)
    for kind, pattern in PATTERNS.items():
        out = out.withColumn(f"z_{kind}", _pieces(kind, pattern))
    return out.select(F.col("id").alias(id_col), *(_spans(kind, 0.0 if kind in BASE else least_score).alias(kind) for kind in PATTERNS))


def _pieces(kind: str, pattern: str) -> Column:
    """(p, m) of each match: the text between the one before and it, and it; null without a match."""
    matches = F.col(f"m_{kind}")
    pieces = F.slice(F.split("text", pattern, -1), F.lit(1), F.size(matches))
    return F.when(F.size(matches) > 0, F.arrays_zip(pieces.alias("p"), matches.alias("m")))


def _spans(kind: str, least_score: float) -> Column:
    """A match ends where the lengths of all pieces and matches up to it add up to; the sums are made in steps that double
    in width, each over the whole array, so no array is copied for each match."""
    z = F.col(f"z_{kind}")
    lengths = F.transform(z, lambda x: (F.length(x["p"]) + F.length(x["m"])).cast("bigint"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(z))).cast("int"))

    def wider(sums: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - back), F.lit(0).cast("bigint")))

    ends = F.aggregate(steps, lengths, wider)

    def span(x: Column, end: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), (end - F.length(x["m"])).cast("bigint").alias("start"), end.alias("end"), x["m"].alias("value"),
            _score(kind, F.right(x["p"], F.lit(NEAR))).alias("score"),
        )

    ended = F.zip_with(z, ends, lambda x, end: F.struct(x.alias("x"), end.alias("end")))
    every = F.transform(F.filter(ended, lambda y: _holds(kind, y["x"]["m"])), lambda y: span(y["x"], y["end"]))
    got = F.filter(every, lambda s: s["score"] >= least_score) if least_score > 0 else every
    return F.coalesce(got, F.array()).cast(f"array<{SPAN}>")


def digest(found: DataFrame, base: list[str], id_col: str = "doc_id") -> DataFrame:
    """Counts, the hash of the base spans and all spans as text, of find_pii()'s result; whether any span was found, and
    the greatest score (0 without one)."""
    more = [k for k in PATTERNS if k not in base]

    def told(kinds: list[str]) -> Column:
        each = [F.transform(k, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))) for k in kinds]
        return F.array_join(F.concat(*each), ",")

    counts = {k: F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS}
    best = F.greatest(*(F.coalesce(F.array_max(F.col(k)["score"]), F.lit(0.0)) for k in PATTERNS))
    return found.select(
        id_col,
        *(counts[k] for k in base),
        F.sha2(told(base), 256).alias("base_sha256"),
        told([*base, *more]).alias("spans"),
        *(counts[k] for k in more),
        (best > 0).alias("found"),
        best.alias("score"),
    )
