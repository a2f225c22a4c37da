"""The grid of gold cases of Welsh verbs: seven constructions by six persons, with the alternatives of each cell in their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import forms
from ..functions.bind import let

# Construction, tense, auxiliary, tense of the lexicon, particle; person and number of the six persons.
GRID = (
    ("synthetic", "present", "", "pres", ""), ("synthetic", "past", "", "past", ""), ("synthetic", "imperfect", "", "imperf", ""), ("periphrastic", "present", "bod", "pres", "yn"),
    ("periphrastic", "past", "gwneud", "past", ""), ("periphrastic", "imperfect", "bod", "imperf", "yn"), ("periphrastic", "future", "bod", "fut", "yn"),
)
PERSONS = (("1s", "1st", "singular"), ("2s", "2nd", "singular"), ("3s", "3rd", "singular"), ("1p", "1st", "plural"), ("2p", "2nd", "plural"), ("3p", "3rd", "plural"))
# The notes of surfaces that are preferred, the best first; then those without a note.
PREFERRED = ("spoken", "short")


#: (tense of the lexicon, person) of the forms that a verb has of its own, and of those of each auxiliary.
_OWN = tuple((c[3], p[0]) for c in GRID if not c[2] for p in PERSONS)
_AUX = tuple((c[2], c[3], p[0]) for c in GRID if c[2] for p in PERSONS)
_NOUN = "infin"


def _note() -> Column:
    note = F.when(F.col("notes").isNull(), len(PREFERRED)).otherwise(len(PREFERRED) + 1)
    for k, name in enumerate(PREFERRED):
        note = F.when(F.col("notes") == name, k).otherwise(note)
    return note


def alternatives(lexicon: DataFrame, *keys: str) -> DataFrame:
    """(keys, surfaces): the different surfaces of each key: the preferred one, then the others as the lexicon has them.

    lexicon: (keys, surface, notes, place). Of the surfaces with the best note the first by place is preferred. Null and empty
    ones are none. Order is kept by sorting a group's few rows by place after they have met.
    """
    rows = lexicon.filter(F.coalesce("surface", F.lit("")) != "")
    ranked = rows.groupBy(*keys).agg(F.min(F.struct(_note().alias("note"), "place", "surface")).alias("best"), F.array_sort(F.collect_list(F.struct("place", "surface"))).alias("all"))
    return ranked.select(*keys, F.array_distinct(F.concat(F.array("best.surface"), F.transform("all", lambda x: x["surface"]))).alias("surfaces"))


def _place(lexicon: DataFrame) -> Column:
    """The place of a row's (tense, person) among a verb's own forms, from 1; 0 for a verb-noun, null for any other."""
    own = F.create_map(*[x for k, (t, p) in enumerate(_OWN, 1) for x in (F.lit(f"{t}/{p}"), F.lit(k))])
    return F.when(F.col("tense") == _NOUN, 0).otherwise(F.try_element_at(own, F.concat(F.col("tense"), F.lit("/"), F.col("person"))))


def _auxiliaries(lexicon: DataFrame) -> DataFrame:
    """One row (aux): for each of ``_AUX`` its surfaces, null if there is none; a few rows, whatever the lexicon's size."""
    rows = lexicon.filter(F.col("lemma").isin(*{a for a, _, _ in _AUX}) & F.col("tense").isin(*{t for _, t, _ in _AUX}))
    found = alternatives(rows.filter("person is not null"), "lemma", "tense", "person").select(F.concat_ws("/", "lemma", "tense", "person").alias("key"), "surfaces")
    every = found.agg(F.map_from_entries(F.collect_list(F.struct("key", "surfaces"))).alias("all"))
    return F.broadcast(every.select(F.array(*[F.try_element_at("all", F.lit("/".join(key))) for key in _AUX]).alias("aux")))


def _surfaces(entries: Column, k: int) -> Column:
    """``alternatives`` of the entries (k, place, surface, note), sorted, of one place of ``_place``; null without any."""

    def ordered(own: Column) -> Column:
        best = F.array_min(F.transform(own, lambda x: F.struct(x["note"].alias("note"), x["place"].alias("place"), x["surface"].alias("surface"))))["surface"]
        return F.when(F.size(own) > 0, F.array_distinct(F.concat(F.array(best), F.transform(own, lambda x: x["surface"]))))

    return let(F.filter(entries, lambda x: x["k"] == k), ordered)


def _cells() -> Column:
    """The 42 cells, a constant; ``at`` is the place in ``_OWN`` (from 0) of a synthetic one, in ``_AUX`` of a periphrastic one."""
    names = ("construction", "tense", "aux_lemma", "look_tense", "particle", "person", "probed_person", "probed_number")
    out = []
    for c in GRID:
        for p in PERSONS:
            at = _AUX.index((c[2], c[3], p[0])) if c[2] else _OWN.index((c[3], p[0]))
            out.append(F.struct(*[F.lit(v).alias(k) for k, v in zip(names, (*c, *p), strict=True)], F.lit("_".join((c[0], c[1], p[0]))).alias("cell_id"), F.lit(at).alias("at")))
    return F.array(*out)


def _piped(words: Column) -> Column:
    return F.array_join(words, "|")


def cases(verbs: DataFrame, lexicon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases, gaps): the gold cases of all verbs, and what the lexicon lacks for the others; a table with gaps isn't to be used.

    verbs: (lemma, verbnoun). lexicon: (lemma, tense, person, surface, notes, place); verb-nouns have the tense ``infin``. A
    synthetic cell has the lemma's forms, a periphrastic one the auxiliary's, and the verb-noun: after the past auxiliary with
    soft mutation first and the plain one as an alternative. match_forms holds what a sentence may have, each once, in order.
    gaps: (lemma, cell_id, missing); a verb without a verb-noun is one gap with a null cell. Verbs meet the lexicon once, before
    they come in 42 cells: as one row for each lemma, for gaps with a bit for each form. The auxiliaries' forms are one row.
    """
    used = lexicon.filter(F.coalesce("surface", F.lit("")) != "").withColumn("k", _place(lexicon)).filter("k is not null")
    aux = _auxiliaries(lexicon)
    return _gold(verbs, used, aux), _gaps(verbs, used, aux)


def _gaps(verbs: DataFrame, used: DataFrame, aux: DataFrame) -> DataFrame:
    bit = F.call_function("shiftleft", F.lit(1), F.col("k"))
    rows = verbs.join(used.groupBy("lemma").agg(F.bit_or(bit).alias("bits")), "lemma", "left").withColumn("bits", F.coalesce("bits", F.lit(0)))
    nounless = rows.filter(F.col("bits") % 2 == 0).select("lemma", F.lit(None).cast("string").alias("cell_id"), F.lit(_NOUN).alias("missing"))
    whole = (2 << len(_OWN)) - 1
    some = rows.filter(F.col("bits") % 2 == 1).crossJoin(aux).filter((F.col("bits").bitwiseAND(whole) != whole) | F.exists("aux", lambda x: x.isNull()))
    own = F.call_function("shiftright", F.col("bits"), F.col("at") + 1) % 2 == 1
    cells = some.select("lemma", "bits", "aux", F.inline(_cells())).filter(F.when(F.col("aux_lemma") == "", ~own).otherwise(F.col("aux")[F.col("at")].isNull()))
    look = F.when(F.col("aux_lemma") == "", F.col("lemma")).otherwise(F.col("aux_lemma"))
    return nounless.unionByName(cells.select("lemma", "cell_id", F.concat_ws("/", look, "look_tense", "person").alias("missing")))


def _gold(verbs: DataFrame, used: DataFrame, aux: DataFrame) -> DataFrame:
    entries = used.groupBy("lemma").agg(F.array_sort(F.collect_list(F.struct("k", "place", "surface", _note().alias("note")))).alias("entries"))
    read = entries.select("lemma", _surfaces(F.col("entries"), 0).alias("nouns"), F.array(*[_surfaces(F.col("entries"), k) for k in range(1, len(_OWN) + 1)]).alias("own")).filter("nouns is not null")
    rows = verbs.join(read, "lemma")
    given = F.coalesce("verbnoun", F.lit(""))
    first = F.when((given != "") & ~F.array_contains("nouns", given), F.concat(F.array(given), F.col("nouns"))).otherwise(F.col("nouns"))
    rows = rows.withColumn("nouns", first).withColumn("soft", F.transform("nouns", lambda w: forms.mutated(w)))
    rows = rows.withColumn("both", F.array_distinct(F.filter(F.concat("soft", "nouns"), lambda w: w != ""))).crossJoin(aux)
    cells = rows.select("lemma", "nouns", "soft", "both", "own", "aux", F.inline(_cells()))
    found = cells.withColumn("surfaces", F.when(F.col("aux_lemma") == "", F.col("own")[F.col("at")]).otherwise(F.col("aux")[F.col("at")])).filter("surfaces is not null")

    synthetic, past = F.col("aux_lemma") == "", (F.col("aux_lemma") != "") & (F.col("tense") == "past")
    found = found.withColumn("words", F.when(synthetic, F.col("surfaces")).when(past, F.col("both")).otherwise(F.col("nouns")))
    rest = lambda c: _piped(F.slice(c, 2, 1 << 30))
    aux_ = lambda c: F.when(synthetic, "").otherwise(c)
    gold = F.when(past, F.col("soft")[0]).otherwise(F.col("words")[0])
    return found.select(
        "lemma", F.col("nouns")[0].alias("verbnoun"), "cell_id", "construction", "tense", "person", "probed_person", "probed_number", "particle", past.alias("requires_soft_mutation"), "aux_lemma",
        aux_(F.col("surfaces")[0]).alias("aux_gold"), aux_(rest("surfaces")).alias("aux_gold_alts"), gold.alias("gold"), rest("words").alias("gold_alts"),
        _piped(F.when(synthetic, F.col("words")).otherwise(F.array_distinct(F.concat("surfaces", "words")))).alias("match_forms"),
    )
