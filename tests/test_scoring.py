"""Scoring functions by golden values."""

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import forms, judge, prompts
from lexiloom.functions import text as T
from lexiloom.operators import evaluators, metrics, paradigm

HABLAR = ["hablo", "hablas", "habla", "hablamos", "habláis", "hablan"]


def _one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


def _score(spark, raw, expected=HABLAR):
    rows = spark.createDataFrame([(raw, expected)], "raw string, expected array<string>")
    return paradigm.score(rows).first()


def test_paradigm_with_labels(spark):
    got = _score(spark, "yo: hablo\ntú: hablas\nél/ella: habla\nnosotros: hablamos\nvosotros: habláis\nellos/ellas: hablan")
    assert got.perfect and got.slots == HABLAR and got.strict_recall == got.assignment_recall == got.presence_recall == 1.0 and got.missing == []


def test_paradigm_labels_out_of_order_gaps_and_bullets(spark):
    got = _score(spark, "1. ellos: hablan\n- yo: Hablo.\n\nhablas\nnosotros: hablan")
    # labelled lines fill their slots, the free line the first empty one; the last label wins
    assert got.slots == ["Hablo", "hablas", None, "hablan", None, "hablan"]
    assert got.strict == 3 and got.missing == ["habla", "hablamos", "habláis"] and not got.perfect
    assert got.strict_recall == 0.5 and got.assignment_recall == 0.5 and got.presence_recall == 0.5


def test_paradigm_without_labels_goes_by_place(spark):
    got = _score(spark, "<think>yo hablo</think>hablo\nhablas\nhabla\nhablamos\nhabla\u0301is\nhablan\nmore")
    assert got.perfect and got.line_forms[4] == "habla"[:5] + "\u0301is"
    swapped = _score(spark, "hablas\nhablo\nhabla\nhabla\nhabla\nhabla")
    assert swapped.strict == 1 and swapped.assignment_recall == 0.5 and swapped.presence_recall == 0.5


def test_paradigm_edges(spark):
    for raw in (None, "", "  \n "):
        got = _score(spark, raw)
        assert got.strict == 0 and got.slots == [None] * 6 and got.missing == HABLAR
    shared = _score(spark, "hablaba\nhablabas\n\n\n", ["hablaba", "hablabas", "hablaba", "hablábamos", "hablabais", "hablaban"])
    assert shared.strict == 2 and shared.assignment_recall == 0.3333 and shared.presence_recall == 0.4


@pytest.mark.parametrize(("raw", "right"), [("Answer: hablado", True), ('"Hablado".', True), ("<think>no</think> hablado\nx", True), ("ha hablado", False), ("", False)])
def test_participle(spark, raw, right):
    assert _one(spark, paradigm.participle_correct(F.lit("hablado"), F.col("raw")), raw=raw) is right


def test_intl_tokens_keep_case_and_part_punctuation(spark):
    assert _one(spark, T.intl_words(F.col("t")), t="Hola, ¿qué tal? 3.5 y 1,000 €5 fin.") == ["Hola", ",", "¿", "qué", "tal", "?", "3.5", "y", "1,000", "€", "5", "fin", "."]


def test_self_bleu(spark):
    rows = spark.createDataFrame([(1, 1, "the cat sat on the mat"), (1, 2, "the cat sat on the mat"), (2, 3, "one two three four"), (2, 4, "five six seven eight"), (3, 5, "alone here")], "grp int, id int, text string")
    got = {r.grp: r.value for r in metrics.self_bleu(rows).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0}
    # case counts, and a full stop is a token: 3 of 4 words, 2 of 3 pairs, 1 of 2 triples, 0 of 1 (smoothed: 1/2)
    near = spark.createDataFrame([(1, 1, "a b c D"), (1, 2, "a b c d")], "grp int, id int, text string")
    assert metrics.self_bleu(near).first().value == round((3 / 4 * 2 / 3 * 1 / 2 * 1 / 2) ** 0.25, 4)


@pytest.mark.parametrize(("given", "expected", "kind"), [
    ("Yo juego al fútbol.", "yo juego al fútbol", "exact"), ("juego al fútbol", "yo juego al fútbol", "lenient-pronoun"), ("yo juego al futbol", "yo juego al fútbol", "lenient-diacritic"),
    ("juego al futbol", "yo juego al fútbol", "lenient-both"), ("juego al tenis", "yo juego al fútbol", "mismatch"), ("", "x", "mismatch"), ("dw i'n mynd i'r ty", "dw i'n mynd i'r tŷ", "lenient-diacritic"),
    ("cafe\u0301", "café", "lenient-diacritic"), ("manana", "mañana", "lenient-diacritic"), ("te hablo", "me hablo", "mismatch"),
])
def test_answer_kind(spark, given, expected, kind):
    assert _one(spark, forms.answer_kind(F.col("g"), F.col("e")), g=given, e=expected) == kind


def test_accents_folded_are_the_welsh_ones(spark):
    assert _one(spark, T.fold_accents(F.col("t")), t="Tŷ ÂÊ ñ ç ã ò") == "ty ae ñ ç ã ò"


@pytest.mark.parametrize(("text", "spanish"), [("the verb does not agree with the subject", False), ("el verbo no concuerda con el sujeto", True), ("ningún problema aunque raro", True), ("verb y sujeto", True), ("xyz", False)])
def test_function_words(spark, text, spanish):
    assert _one(spark, judge.mostly_spanish(F.col("t")), t=text) is spanish


def test_stub_without_a_keyword_and_perplexity_without_tokens(spark):
    rows = spark.createDataFrame([(1, "Yo hablo", None, " "), (2, "", "hablar", "I speak"), (3, "Yo como", "hablar", "I eat")], "sentence_id int, text string, keyword string, translation string")
    assert [r.score for r in evaluators.grammar_stub(rows).orderBy("sentence_id").collect()] == [0.6667, 0.3333, 0.6667]
    scored = evaluators.perplexity(spark.createDataFrame([(1, None), (2, 0.0), (3, -1.0)], "sentence_id int, mean_nll double")).orderBy("sentence_id")
    assert [r.score for r in scored.collect()] == [0.0, 1.0, 1.0]


def test_keyterms_and_demonstrations(spark):
    row = spark.range(1).select(
        T.keyterms(F.lit("¿Hola, HOLA mundo! — mundo, Ana")).alias("terms"),
        F.round(forms.quality_score(F.lit("correr"), F.lit(4.0)), 6).alias("quality"),
        prompts.demonstration_block(F.array(F.struct(F.lit("hablar").alias("verb"), F.lit("speak").alias("translation"), F.lit("present").alias("label"), F.lit("Yo hablo.").alias("sentence")))).alias("block"),
    ).first()
    assert row.terms == ["Hola", "mundo", "Ana"] and row.quality == 4.03
    assert row.block == prompts.HEAD + "\n\nExample 1 — hablar (to speak), present:\nYo hablo.\n\n---"


def _dealt(sizes, rooms, n):
    """Quotas one by one: the whole part of each share within its room, then in turns."""
    room = {k: min(s, rooms[k]) for k, s in sizes.items()}
    share = {k: n * s / sum(sizes.values()) for k, s in sizes.items()}
    out = {k: min(room[k], int(share[k])) for k in sizes}
    turns = sorted(sizes, key=lambda k: (out[k] - share[k], k))
    while sum(out.values()) < n:
        for k in turns:
            if sum(out.values()) < n and out[k] < room[k]:
                out[k] += 1
    return out


def test_capped_quotas_equal_turns(spark):
    import random

    import pytest

    from lexiloom.operators import sampling

    rnd = random.Random(8)
    for case in range(12):
        sizes = {f"k{i}": rnd.randint(1, 60) for i in range(rnd.randint(1, 9))}
        rooms = {k: rnd.randint(0, 40) for k in sizes}
        most = sum(min(s, rooms[k]) for k, s in sizes.items())
        strata = spark.createDataFrame([(k, s, rooms[k]) for k, s in sizes.items()], "k string, size long, room long").coalesce(1)
        n = most if case % 4 == 0 else rnd.randint(0, most)
        assert {r.k: r.quota for r in sampling.capped_quotas(strata, n, "k").collect()} == _dealt(sizes, rooms, n)
    with pytest.raises(Exception, match="capacity for"):
        sampling.capped_quotas(strata, most + 1, "k").collect()
