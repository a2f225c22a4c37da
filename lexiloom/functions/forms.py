"""Word forms: initial mutations, regular inflection, frequency tiers, answer checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold_accents, without_diacritics

# Initial consonants and what they become, digraphs first.
SOFT = (("ll", "l"), ("rh", "r"), ("ph", "ph"), ("th", "th"), ("ch", "ch"), ("ng", "ng"), ("p", "b"), ("t", "d"), ("c", "g"), ("b", "f"), ("d", "dd"), ("g", ""), ("m", "f"))
NASAL = (("p", "mh"), ("t", "nh"), ("c", "ngh"), ("b", "m"), ("d", "n"), ("g", "ng"))
ASPIRATE = (("p", "ph"), ("t", "th"), ("c", "ch"))
# Subject pronouns of both languages, also as typed without accents.
PRONOUNS = ("yo tú tu él el ella usted nosotros nosotras vosotros vosotras ellos ellas ustedes i you he she it we they").split()
# Regular endings by class (ar, er, ir), for 1s 2s 3s 1p 2p 3p.
SPANISH_ENDINGS = {
    "present": {"ar": "o as a amos áis an", "er": "o es e emos éis en", "ir": "o es e imos ís en"},
    "preterite": {"ar": "é aste ó amos asteis aron", "er": "í iste ió imos isteis ieron", "ir": "í iste ió imos isteis ieron"},
    "imperfect": {"ar": "aba abas aba ábamos abais aban", "er": "ía ías ía íamos íais ían", "ir": "ía ías ía íamos íais ían"},
    "future": {"ar": "aré arás ará aremos aréis arán", "er": "eré erás erá eremos eréis erán", "ir": "iré irás irá iremos iréis irán"},
    "conditional": {"ar": "aría arías aría aríamos aríais arían", "er": "ería erías ería eríamos eríais erían", "ir": "iría irías iría iríamos iríais irían"},
}
SLOTS = ("1s", "2s", "3s", "1p", "2p", "3p")


def _chain(cases: list[tuple[Column, Column]], other: Column) -> Column:
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), other)


def mutated(word: Column, rules: tuple[tuple[str, str], ...] = SOFT) -> Column:
    """The word with its initial changed by the first rule that fits; a capital initial stays one."""
    low = F.lower(word)
    out = _chain([(low.startswith(a), F.concat(F.lit(b), F.substring(low, F.lit(len(a) + 1), F.length(low)))) for a, b in rules], F.lit(None).cast("string"))
    initial = F.substring(word, 1, 1)
    title = (initial != F.lower(initial)) & (word != F.upper(word))
    return F.when(out.isNull(), word).when(title, F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, F.lit(2), F.length(out)))).otherwise(out)


def tier(zipf: Column, low: float, high: float) -> Column:
    """low below ``low``, high from ``high`` on, else mid."""
    return F.when(zipf < low, "low").when(zipf >= high, "high").otherwise("mid")


def quality_score(word: Column, zipf: Column) -> Column:
    """zipf, a bonus for the -ar and -er endings, and 0.01 for each letter beyond five up to 0.1."""
    return zipf + F.when(word.endswith("ar"), 0.05).when(word.endswith("er"), 0.02).otherwise(0.0) + F.least(F.lit(0.1), 0.01 * F.greatest(F.lit(0), F.length(word) - 5))


def english_regular(lemma: Column) -> Column:
    """lemma, -s, past and -ing forms of a regular verb."""
    stem = F.substring(lemma, F.lit(1), F.length(lemma) - 1)
    e, y = lemma.endswith("e"), F.rlike(lemma, F.lit("[^aeiou]y$"))
    s = F.when(y, F.concat(stem, F.lit("ies"))).when(F.rlike(lemma, F.lit("(s|x|z|ch|sh|o)$")), F.concat(lemma, F.lit("es"))).otherwise(F.concat(lemma, F.lit("s")))
    past = F.when(e, F.concat(lemma, F.lit("d"))).when(y, F.concat(stem, F.lit("ied"))).otherwise(F.concat(lemma, F.lit("ed")))
    ing = F.when(e, F.concat(stem, F.lit("ing"))).otherwise(F.concat(lemma, F.lit("ing")))
    return F.array(lemma, s, past, ing)


def spanish_regular(verb: Column, tense: Column | str, slot: Column | str) -> Column:
    """The regular form, or null for other endings, tenses and slots. Of a tense and slot given as strings only three endings are looked at."""
    stem, kind = F.substring(verb, F.lit(1), F.length(verb) - 2), F.substring(verb, -2, 2)
    if isinstance(tense, str) and isinstance(slot, str):
        return F.concat(stem, _chain([(kind == c, F.lit(ends.split()[SLOTS.index(slot)])) for c, ends in SPANISH_ENDINGS[tense].items()], F.lit(None).cast("string")))
    table = F.create_map(*[F.lit(x) for t, own in SPANISH_ENDINGS.items() for c, ends in own.items() for s, e in zip(SLOTS, ends.split(), strict=True) for x in (f"{t} {c} {s}", e)])
    return F.concat(stem, F.try_element_at(table, F.concat_ws(" ", tense, kind, slot)))


def corpus_zipf(per_million: Column) -> Column:
    return F.when(per_million > 0, F.log10(per_million) + 3).otherwise(F.lit(0.0))


# The characters that don't count in an answer.
_IGNORED = "[.,!?¿¡;:\"'“”„«»…—–-]"


def _plain(answer: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(answer)), _IGNORED, ""), "(?U)\\s+", " "))


def _without_pronoun(answer: Column) -> Column:
    head = F.substring_index(answer, " ", 1)
    return F.when(F.contains(answer, F.lit(" ")) & head.isin(PRONOUNS), F.substring(answer, F.length(head) + 2, F.length(answer))).otherwise(answer)


def answer_kind(given: Column, expected: Column) -> Column:
    """exact, lenient-pronoun, lenient-diacritic, lenient-both or mismatch, the first that holds."""
    u, e = _plain(given), _plain(expected)
    bare_u, bare_e = _without_pronoun(u), _without_pronoun(e)
    dropped = (bare_u != u) | (bare_e != e)
    fold = without_diacritics
    return (
        F.when(u == "", "mismatch")
        .when(u == e, "exact")
        .when(dropped & (bare_u == bare_e), "lenient-pronoun")
        .when(fold(u) == fold(e), "lenient-diacritic")
        .when(dropped & (fold(bare_u) == fold(bare_e)), "lenient-both")
        .otherwise("mismatch")
    )


def foil(gold: Column, candidates: list[tuple[str, Column]]) -> Column:
    """The first candidate (kind, form) that isn't null, empty or a gold form."""
    rows = F.array(*[F.struct(F.lit(kind).alias("kind"), form.alias("form")) for kind, form in candidates])
    norm = F.transform(gold, lambda g: F.lower(F.trim(g)))
    return F.get(F.filter(rows, lambda c: c["form"].isNotNull() & (c["form"] != "") & ~F.array_contains(norm, F.lower(F.trim(c["form"])))), F.lit(0))


# Endings of verbs in -oi, longest first, and what else they may be written as; shortest stems.
OI_ENDINGS = (
    ("oaist", ()), ("oais", ()), ("oaf", ()), ("oiwch", ()), ("oiwn", ()), ("oiant", ()), ("oant", ()), ("oist", ("oaist",)), ("ois", ("oais",)), ("owch", ("oiwch",)), ("own", ("oiwn",)),
    ("ont", ("oant", "oiant")), ("of", ("oaf",)), ("oai", ()), ("on", ("oant", "oiant")), ("oi", ("oai",)),
)
_TRUE = ("1", "true", "yes", "y")


def mutation_policy(construction: Column, tense: Column, required: Column, explicit: Column) -> Column:
    """soft_optional, soft_required or none: which mutated forms a cell accepts."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (
        F.when(low(required).isin(*_TRUE), "soft_optional")
        .when((low(construction) == "periphrastic") & (low(tense) == "past"), "soft_optional")
        .when(low(explicit).isin("soft", "soft_optional"), "soft_optional")
        .when(low(explicit).isin("soft_required", "required_soft"), "soft_required")
        .otherwise("none")
    )


def with_mutations(forms: Column, policy: Column) -> Column:
    """The forms, and their soft mutations if the policy has them; blanks and repeats (whatever their case) are left out."""
    base = F.filter(F.transform(forms, lambda f: F.trim(f)), lambda f: f != "")
    every = F.when(policy.isin("soft_optional", "soft_required"), F.concat(base, F.filter(F.transform(base, lambda f: mutated(f)), lambda f: f != ""))).otherwise(base)
    return F.aggregate(every, F.array().cast("array<string>"), lambda out, f: F.when(F.exists(out, lambda o: F.lower(o) == F.lower(f)), out).otherwise(F.concat(out, F.array(f))))


def oi_variants(form: Column, lemma: Column) -> Column:
    """A form of a verb in -oi and how else its ending may be written; other forms, and the lemma itself, only as they are."""
    own, verb = fold_accents(F.trim(form)), fold_accents(F.trim(lemma))
    rest = _chain(
        [
            (own.endswith(end) & (F.length(own) - len(end) >= (3 if end in ("on", "oi") else 2)), F.array(*[F.concat(F.substring(own, F.lit(1), F.length(own) - len(end)), F.lit(e)) for e in other]) if other else F.array().cast("array<string>"))
            for end, other in OI_ENDINGS
        ],
        F.array().cast("array<string>"),
    )
    stem = F.substring(verb, F.lit(1), F.greatest(F.length(verb) - 2, F.least(F.length(verb) - 1, F.lit(2))))
    fits = (verb == "") | (verb.endswith("oi") & own.startswith(stem) & (F.lower(F.trim(form)) != F.lower(F.trim(lemma))))
    return F.when(F.trim(form) == "", F.array().cast("array<string>")).when(fits, F.concat(F.array(F.trim(form)), F.filter(rest, lambda r: r != own))).otherwise(F.array(F.trim(form)))


def summed_zipf(forms, frequencies, key: str = "verb"):
    """(key, zipf) of rows (key, forms array): the Zipf value of the forms' summed frequency, else of the bare word, else 0."""
    each = forms.select(key, F.explode(F.array_distinct("forms")).alias("word")).join(frequencies, "word").groupBy(key).agg(F.sum("frequency").alias("total"))
    bare = frequencies.select(F.col("word").alias(key), F.col("frequency").alias("bare"))
    rows = forms.select(key).join(each, key, "left").join(bare, key, "left")
    total = F.coalesce(F.when(F.col("total") > 0, F.col("total")), "bare", F.lit(0.0))
    return rows.select(key, F.when(total > 0, F.log10(total * 1e9)).otherwise(0.0).alias("zipf"))


def is_verb_candidate(word: Column) -> Column:
    """A word of letters only, four or more, that ends in ar, er or ir."""
    return F.rlike(word, F.lit("^\\p{L}{2,}(ar|er|ir)$"))


# The cells of a Spanish paradigm in their order, and participles that are other words.
PARADIGM = tuple("/".join((t, p, n)) for t in SPANISH_ENDINGS for n in ("singular", "plural") for p in ("1st", "2nd", "3rd"))
NO_PARTICIPLES = "incluso junto salvo solido sólido valido válido omiso aflicto".split()
_SPANISH_LETTERS = "^[A-Za-zÁÉÍÓÚÜáéíóúüñÑ]+$"


def paradigm_reason(verb: Column, participle: Column, cells: Column, blocked: tuple[str, ...] = ()) -> Column:
    """Why a verb's paradigm can't be used, the first reason there is, or ``ok``.

    cells: map<string, string> of the names of ``PARADIGM`` to forms. Reasons: noun_adj_like (blocked, or in -ajear);
    bad_preterite_1sg (none, or in -ía); bad_participle (none, or signs other than letters); bad_participle_surface:<it> (no ending
    of a participle, or another word); then for the first cell that fails, in the paradigm's order, missing:<cell>,
    junk_form:<cell>:<form> or verbecc_garbage:<form> (-ach- in a verb in -cer without it); present_1sg_eq_infinitive;
    bad_stem_change_preterite. Null cells are missing, a null verb has no reason but those of its forms.
    """
    verb_ = F.coalesce(verb, F.lit(""))
    low = F.lower(participle)
    yo, preterite = cells["present/1st/singular"], cells["preterite/1st/singular"]

    def bad(cell: Column) -> Column:
        name, form = cell["name"], cell["form"]
        junk = F.when(F.coalesce(form, F.lit("")) == "", F.concat(F.lit("missing:"), name)).when(~form.rlike(_SPANISH_LETTERS), F.concat(F.lit("junk_form:"), name, F.lit(":"), form))
        return junk.when(form.contains("ach") & verb_.endswith("cer") & ~verb_.contains("ach"), F.concat(F.lit("verbecc_garbage:"), form))

    # each cell is looked up once, and its form is a value from then on
    forms = F.array(*[F.struct(F.lit(name).alias("name"), cells[name].alias("form")) for name in PARADIGM])
    each = F.get(F.filter(F.transform(forms, bad), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(
        F.when(verb_.isin(*blocked) | verb_.endswith("ajear") if blocked else verb_.endswith("ajear"), "noun_adj_like"),
        F.when(preterite.isNull() | preterite.endswith("ía"), "bad_preterite_1sg"),
        F.when(~F.coalesce(participle.rlike(_SPANISH_LETTERS), F.lit(False)), "bad_participle"),
        F.when(~low.rlike("(ado|ido|to|so|cho)$") | low.isin(NO_PARTICIPLES), F.concat(F.lit("bad_participle_surface:"), participle)),
        each,
        F.when(yo == verb_, "present_1sg_eq_infinitive"),
        F.when((verb_ == "podrir") | (preterite.endswith("odrí") & yo.startswith("pud")), "bad_stem_change_preterite"),
        F.lit("ok"),
    )
