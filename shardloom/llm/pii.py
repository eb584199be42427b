"""Personal data in texts: patterns propose spans, checks confirm them, words before a span adjust its score.

All of it is column expressions. A pattern's matches are set off with a marker character, the text is split
there, and one fold over the pieces counts characters, so every span knows its place. No pattern restarts inside
a run that it has failed on, so a text costs time in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MARK, _OTHER = "\u0001", "\u0002"  # neither is part of any pattern
_SPAN = "struct<kind:string,start:int,end:int,score:double>"
# Spans gathered before they are set aside; keeps the fold linear for texts with very many.
_CHUNK = 256
CONTEXT_CHARS = 48
KEEP_SCORE = 0.5


@dataclass(frozen=True)
class Detector:
    """``base`` spans stay whatever their score; others need ``KEEP_SCORE``."""

    kind: str
    pattern: str
    confirm: Callable[[Column], Column]
    score: float
    bonus: float
    context: str
    base: bool


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _chars(x: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.substring(x, i, F.lit(1)))


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn checksum. An empty string does not."""
    folded = F.aggregate(
        _chars(F.reverse(digits)),
        F.struct(F.lit(0).alias("sum"), F.lit(False).alias("twice")),
        lambda a, c: F.struct(
            (
                a["sum"] + c.cast("int")
                + F.when(a["twice"], c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(0)
            ).alias("sum"),
            (~a["twice"]).alias("twice"),
        ),
    )
    return F.when(F.length(digits) > 0, folded["sum"] % 10 == 0).otherwise(False)


def mod97(account: Column) -> Column:
    """Whether an account number passes the mod-97 checksum: first four characters last, letters as 10 to 35."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    rest = F.aggregate(
        _chars(turned), F.lit(0),
        lambda a, c: (a * F.when(c.rlike("[A-Z]"), 100).otherwise(10) + F.conv(c, 36, 10).cast("int")) % 97,
    )
    return F.when(F.length(plain) > 4, rest == 1).otherwise(False)


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

# Base kinds in their fixed order, then the kinds that this method adds.
DETECTORS = (
    Detector(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda x: F.lit(True), 0.9, 0.1, r"(?i)\b(?:e-?mail|contact|write|correo|courriel)\b", True,
    ),
    Detector(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda x: x.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), 0.6, 0.3, r"(?i)\b(?:ip|address|host|server|login)\b", True,
    ),
    Detector(
        "card",
        r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){12,18}+(?![ -]?[0-9])",
        lambda x: luhn(_digits(x)), 0.7, 0.3, r"(?i)\b(?:card|visa|credit|karte|tarjeta|carte)\b", True,
    ),
    Detector(
        "phone",
        r"\+[0-9][ ().0-9-]+[0-9]",
        lambda x: F.length(_digits(x)).between(9, 15), 0.7, 0.3, r"(?i)\b(?:call|phone|tel|mobile|fax|telefon)\b", True,
    ),
    Detector(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        mod97, 0.8, 0.2, r"(?i)\b(?:iban|account|bank|konto|cuenta|compte)\b", False,
    ),
    Detector(
        "ssn",
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        lambda x: F.lit(True), 0.3, 0.4, r"(?i)\b(?:ssn|social security)\b", False,
    ),
)


def _spans(text: Column, d: Detector) -> Column:
    """Confirmed spans of one kind in order, as character offsets, end exclusive."""
    pieces = F.split(F.regexp_replace(text, d.pattern, f"{_MARK}$0{_MARK}"), _MARK)
    none = F.array().cast(f"array<{_SPAN}>")
    start = F.struct(
        F.lit(0).alias("at"), F.lit(False).alias("match"), F.lit("").alias("left"), none.alias("now"),
        F.array().cast(f"array<array<{_SPAN}>>").alias("done"),
    )

    def step(a: Column, x: Column) -> Column:
        end = a["at"] + F.length(x)
        near = a["left"].rlike(d.context)
        score = F.lit(d.score) + F.when(near, d.bonus).otherwise(0.0)
        keep = a["match"] & F.coalesce(d.confirm(x), F.lit(False))
        if not d.base:
            keep = keep & (score >= KEEP_SCORE)
        span = F.struct(
            F.lit(d.kind).alias("kind"), a["at"].alias("start"), end.alias("end"), F.round(score, 3).alias("score")
        )
        full = F.size(a["now"]) >= _CHUNK
        held = F.when(full, none).otherwise(a["now"])
        return F.struct(
            end.alias("at"), (~a["match"]).alias("match"),
            F.when(a["match"], F.lit("")).otherwise(F.right(x, F.lit(CONTEXT_CHARS))).alias("left"),
            F.when(keep, F.concat(held, F.array(span))).otherwise(held).alias("now"),
            F.when(full, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]).alias("done"),
        )

    return F.aggregate(pieces, start, step, lambda a: F.flatten(F.concat(a["done"], F.array(a["now"]))))


def _listed(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` and ``base_spans``, ``added_spans``: arrays of kind, start, end and score.

    Offsets are code points. A null or empty text has no spans. Columns of these names in ``docs`` are
    replaced. Each row stands for itself, repeated ids included.
    """
    names = [f"__{d.kind}" for d in DETECTORS]
    kept = [c for c in docs.columns if c not in ("base_spans", "added_spans", "__plain", *names)]
    plain = F.translate(F.coalesce(F.col("text"), F.lit("")), _MARK, _OTHER)
    found = docs.select(*kept, plain.alias("__plain"))
    found = found.select(*kept, *[_spans(F.col("__plain"), d).alias(n) for d, n in zip(DETECTORS, names)])
    base = [F.col(n) for d, n in zip(DETECTORS, names) if d.base]
    added = [F.col(n) for d, n in zip(DETECTORS, names) if not d.base]
    return found.select(*kept, F.concat(*base).alias("base_spans"), F.concat(*added).alias("added_spans"))


def pii_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, min_score`` of each row."""
    found = find_pii(docs.select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    every = F.concat("base_spans", "added_spans")
    return found.select(
        "doc_id", *[count(d.kind) for d in DETECTORS if d.base],
        F.sha2(_listed(F.col("base_spans")), 256).alias("base_sha256"), _listed(every).alias("spans"),
        F.size("added_spans").cast("long").alias("n_added"),
        F.array_min(F.transform(every, lambda s: s["score"])).alias("min_score"),
    )


def redact_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with every span, overlapping ones together, replaced by the first one's kind in brackets.

    A null text stays null. The columns and their order stay the same.
    """
    found = find_pii(docs)
    ordered = F.array_sort(F.transform(
        F.concat("base_spans", "added_spans"),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
    ))
    none = F.array().cast("array<struct<start:int,end:int,kind:string,before:int>>")
    # ``before``: where the kept text in front of the span begins.
    runs = F.aggregate(
        ordered, none,
        lambda a, s: F.when(
            (F.size(a) > 0) & (s["start"] < F.element_at(a, -1)["end"]),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(
                F.element_at(a, -1)["start"].alias("start"),
                F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end"),
                F.element_at(a, -1)["kind"].alias("kind"), F.element_at(a, -1)["before"].alias("before"),
            ))),
        ).otherwise(F.concat(a, F.array(F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"),
            F.coalesce(F.try_element_at(a, F.lit(-1))["end"], F.lit(0)).alias("before"),
        )))),
    )
    staged = found.withColumn("__runs", runs)
    text = F.col("text")
    cut = F.transform("__runs", lambda r: F.concat(
        F.substring(text, r["before"] + 1, r["start"] - r["before"]), F.lit("["), F.upper(r["kind"]), F.lit("]")
    ))
    tail = F.substring(text, F.element_at("__runs", -1)["end"] + 1, F.length(text))
    clean = F.when(F.size("__runs") > 0, F.concat(F.array_join(cut, ""), tail)).otherwise(text)
    return staged.withColumn("text", clean).select(*docs.columns)
