"""Scores of verb paradigms: replies with six lines, one for each person, against the six gold forms.

All of it is array expressions over rows (raw string, expected array<string>): no row leaves the JVM, no exchange is made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.bind import let

# Labels of the persons in the order in which they are tried, with their slots; pronouns; edge punctuation.
LABELS = (
    ("él/ella", 2), ("nosotros", 3), ("nosotras", 3), ("vosotros", 4), ("vosotras", 4), ("nosotros/nosotras", 3), ("vosotros/vosotras", 4),
    ("ellos/ellas", 5), ("yo", 0), ("tú", 1), ("tu", 1), ("él", 2), ("ella", 2), ("ellos", 5), ("ellas", 5),
)
PRONOUNS = ("yo", "tú", "tu", "él", "ella", "nosotros", "nosotras", "vosotros", "vosotras", "ellos", "ellas")
EDGES = ".,;:!?\"'«»“”‘’¡¿()[]{}"
SLOTS = 6
_WORD, _BULLET = "(?U)[\\w]+", "(?U)^[-*•\\d.)\\s]+"
#: The first label in their order that the line starts with, before the line's end or a sign that may follow.
_LABEL = f"^({'|'.join(label for label, _ in LABELS)})($|[:.,/ )])"


def normal_form(form: Column) -> Column:
    """For comparison: marks composed, without punctuation at the ends, case-folded."""
    return T.casefold(F.trim(T.composed(form), F.lit(EDGES)))


def _normal_word(word: Column) -> Column:
    """normal_form of a match of ``_WORD``, which has no punctuation at its ends."""
    return T.casefold(T.composed(word))


def _thought(raw: Column) -> Column:
    return F.when(F.contains(raw, F.lit("<think>")), F.regexp_replace(raw, "(?s)<think>.*?(</think>|$)", "")).otherwise(raw)


def tokens(raw: Column) -> Column:
    return F.regexp_extract_all(_thought(raw), F.lit(f"({_WORD})"), 1)


def first_token(reply: Column) -> Column:
    """The first word of a reply's first line, after a label such as "Answer:"; the line itself if it has no word."""
    line = F.trim(F.substring_index(F.trim(_thought(reply), F.lit(" \t\r\n")), "\n", 1), F.lit(" \t\r"))
    line = F.trim(F.regexp_replace(line, "(?i)^(answer|response|respuesta)\\s*:\\s*", ""), F.lit("\"'` "))
    return let(line, lambda line: let(F.regexp_extract(line, "(?U)([\\w'\\-]+)", 1), lambda word: F.when(word != "", word).otherwise(line)))


def _labelled(cleaned: Column, label: Column) -> tuple[Column, Column]:
    """The slot of the line's label (empty: null), and the rest of the line."""
    slots = F.create_map(*[F.lit(x) for pair in LABELS for x in pair])
    rest = F.when(label != "", F.substring(cleaned, F.length(label) + 1, F.length(cleaned))).otherwise(cleaned)
    return F.try_element_at(slots, label), F.ltrim(rest, F.lit(":.,/ )"))


def _verb(rest: Column) -> Column:
    """The first word that isn't a pronoun."""
    return F.get(F.filter(F.regexp_extract_all(rest, F.lit(f"({_WORD})"), 1), lambda w: ~T.casefold(w).isin(*PRONOUNS)), F.lit(0))


def parsed(rows: DataFrame) -> DataFrame:
    """rows with slots (the form that the reply gives each person) and line_forms (the verb of each of the first six lines).

    Lines with a label fill its slot, the last one wins; lines without one fill the empty slots in order. If no slot is filled
    by a label, lines go by their place.
    """
    trimmed = F.transform(F.split(_thought(F.coalesce("raw", F.lit(""))), "\\R"), lambda x: F.trim(x, F.lit(" \t\r")))
    lines = rows.withColumn("_cleaned", F.transform(F.filter(trimmed, lambda x: x != ""), lambda x: F.trim(F.regexp_replace(x, _BULLET, ""))))

    def line(cleaned: Column) -> Column:
        def named(label: Column) -> Column:
            slot, rest = _labelled(cleaned, label)
            # the first word of a line counts only where a label gives it a slot
            return let(rest, lambda rest: F.struct(slot.alias("slot"), F.when((label != "") & (rest != ""), first_token(rest)).alias("token"), _verb(rest).alias("verb")))

        return let(F.regexp_extract(T.casefold(cleaned), _LABEL, 1), named)

    out = lines.withColumn("_lines", F.transform("_cleaned", line)).drop("_cleaned")
    out = out.withColumns(
        {
            "_named": F.reverse(F.filter("_lines", lambda x: x["token"] != "")),
            "_free": F.filter("_lines", lambda x: x["slot"].isNull()),
            "line_forms": F.array(*[F.get("_lines", F.lit(i))["verb"] for i in range(SLOTS)]),
        }
    )
    named = F.col("_named")
    out = out.withColumn("_own", F.array(*[F.get(named["token"], (F.array_position(named["slot"], i) - 1).cast("int")) for i in range(SLOTS)]))
    filled = []
    for i in range(SLOTS):
        before = reduce(lambda a, b: a + b, (F.get("_own", F.lit(k)).isNull().cast("int") for k in range(i)), F.lit(0))
        filled.append(F.coalesce(F.get("_own", F.lit(i)), F.get("_free", before)["verb"]))
    return out.withColumn("slots", F.when(F.size("_named") == 0, F.col("line_forms")).otherwise(F.array(*filled))).drop("_lines", "_named", "_own", "_free")


def assigned(expected: Column, given: Column) -> Column:
    """How many gold forms take a line of their own: for each form the smaller of its numbers on both sides.

    Walking the gold forms and using up one equal line for each gives the same number.
    """
    both = F.struct(F.transform(expected, normal_form).alias("gold"), F.transform(given, normal_form).alias("have"))
    return let(both, lambda both: _shared(both["gold"], both["have"]))


def _shared(gold: Column, have: Column) -> Column:
    """The size of the intersection of two arrays with repeats; both are named for every element, so give columns. Nulls are in none."""
    count = lambda array, form: F.size(F.filter(array, lambda x: x == form))
    return F.aggregate(F.array_distinct(gold), F.lit(0), lambda n, form: n + F.least(count(gold, form), count(have, form)))


def score(rows: DataFrame) -> DataFrame:
    """rows (raw, expected) with slots, strict, strict_recall, assignment_recall, presence_recall (4 places), perfect and missing.

    A null reply is an empty one; missing lists the gold forms whose slot differs.
    """
    out = parsed(rows)
    # each form is brought to its normal form once
    normal = {"_gold": F.transform("expected", normal_form), "_slots": F.transform("slots", normal_form), "_lines": F.transform("line_forms", _normal_word), "_said": F.transform(tokens(F.coalesce("raw", F.lit(""))), _normal_word)}
    out = out.withColumns(normal).withColumn("_right", F.zip_with("_gold", "_slots", lambda gold, own: F.coalesce(own == gold, F.lit(False))))
    size, strict = F.size("expected"), F.size(F.filter("_right", lambda x: x))
    return out.withColumns(
        {
            "strict": strict,
            "strict_recall": F.round(strict / size, 4),
            "assignment_recall": F.round(_shared(F.col("_gold"), F.col("_lines")) / size, 4),
            "presence_recall": F.round(F.size(F.array_intersect("_gold", "_said")) / F.size(F.array_distinct("_gold")), 4),
            "perfect": F.forall("_right", lambda x: x),
            "missing": F.transform(F.filter(F.arrays_zip(F.col("expected").alias("form"), F.col("_right").alias("right")), lambda x: ~x["right"]), lambda x: x["form"]),
        }
    ).drop("_right", *normal)


def participle_correct(expected: Column, raw: Column) -> Column:
    """Whether the reply's first word is the gold form."""
    return normal_form(first_token(raw)) == normal_form(expected)


def package(tokens: Column, aux: Column, particle: Column, forms: Column, packages: Column) -> Column:
    """aux_ok, particle_ok, form_ok and package_ok of a reply in several words: one of the packages (arrays of tokens) as it
    stands, or all the parts that are asked for. An empty ``aux`` and an empty particle ask for nothing; no tokens fail in all."""
    said = F.size(tokens) > 0
    whole = F.array_join(tokens, " ")
    one_of = lambda wanted: F.exists(wanted, lambda w: F.array_contains(tokens, w) | (w == whole))
    own = F.coalesce(particle, F.lit(""))
    parts = {"aux_ok": (F.size(aux) == 0) | one_of(aux), "particle_ok": (own == "") | F.array_contains(tokens, own), "form_ok": one_of(forms)}
    held = {name: F.coalesce(said & ok, F.lit(False)) for name, ok in parts.items()}
    exact = said & F.exists(packages, lambda p: p == tokens)
    every = held["aux_ok"] & held["particle_ok"] & held["form_ok"]
    return F.struct(*[ok.alias(name) for name, ok in held.items()], (F.coalesce(exact, F.lit(False)) | every).alias("package_ok"))
