"""State along tokens, jobs, runs and configurations: golden values and brute-force versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import automata, forms
from lexiloom.operators import rescoring, views, welsh
from lexiloom.streaming.tracker import advanced

TEXTS = "tok array<string>, gold array<array<string>>, banned array<array<string>>"


def _trace(spark, tokens, gold, banned):
    df = spark.createDataFrame([(tokens, gold, banned)], TEXTS)
    return df.select(F.posexplode(automata.trace(F.col("tok"), F.col("gold"), F.col("banned"))).alias("at", "s"), "gold", "banned").select(
        "at", F.col("s.gold").alias("golds"), F.col("s.banned").alias("bans"), "s.satisfied", "s.violated", automata.progress(F.col("s"), F.col("gold")).alias("progress"), automata.clauses(F.col("s")).alias("clauses"), automata.beam_key(F.col("s"), F.col("banned")).alias("key"), automata.score(F.lit(-1.0), F.col("s"), F.col("gold"), 0.1).alias("score")
    ).orderBy("at").collect()


def test_prefix_advances_and_completes(spark):
    rows = _trace(spark, ["1", "2", "3"], [["1", "2", "3"]], [])
    assert [(r.satisfied, round(r.progress, 6), r.clauses) for r in rows] == [(False, 0.333333, 1), (False, 0.666667, 1), (True, 1.0, 2)]


def test_a_ban_ends_the_text_for_good(spark):
    rows = _trace(spark, ["9", "9", "1"], [["1"]], [["9", "9"]])
    assert [(r.satisfied, r.violated, r.clauses) for r in rows] == [(False, False, 1), (False, True, 0), (False, True, 0)]
    assert [r.key for r in rows] == [["neg_partial:0"], [], []]


def test_score_rewards_a_prefix(spark):
    rows = _trace(spark, ["1", "2"], [["1", "2"]], [])
    assert [r.score for r in rows] == [-1.0 + 0.1 * 0.5, -1.0]


def test_restart_rule(spark):
    """A token that doesn't go on begins anew only if it's the first one; a match inside of a failed one is lost."""
    rows = _trace(spark, ["a", "a", "b", "x", "a", "b"], [["a", "b"], ["a", "a", "b", "a"]], None)
    assert [list(r.golds) for r in rows] == [[1, 1], [1, 2], [2, 3], [2, 3], [2, 3], [2, 3]]  # nothing is followed once gold is completed
    rows = _trace(spark, ["a", "b", "a", "b", "c"], [["a", "b", "c"]], [])
    assert [list(r.golds) for r in rows] == [[1], [2], [1], [2], [3]]
    rows = _trace(spark, ["b", "b", "b", "c"], [["b", "b", "c"]], [])
    assert [list(r.golds) for r in rows] == [[1], [2], [1], [0]]


def test_trace_equals_a_step_by_step_walk(spark):
    rnd = random.Random(1)
    for length in (0, 1, 63, 64, 65, 200):
        tokens = [rnd.choice(["a", "b", "c", None]) for _ in range(length)]
        gold, banned = [["a", "b", "a", "c"], [], ["c", "c", "c"]], [["b", "b", "b", "a", "b", "c"]]
        g, b, sat, vio, expected = [0] * 3, [0], False, False, []
        for t in tokens:
            if not vio:
                b = advanced(b, banned, t)
                vio = b[0] == 6
            if not vio and not sat:
                g = advanced(g, gold, t)
                sat = g[0] == 4 or g[2] == 3
            expected.append((g, b, sat, vio))
        assert [(list(r.golds), list(r.bans), r.satisfied, r.violated) for r in _trace(spark, tokens, gold, banned)] == expected


def test_null_and_empty_streams(spark):
    assert _trace(spark, None, [["a"]], [["b"]]) == [] == _trace(spark, [], None, None)
    (row,) = _trace(spark, ["a"], None, None)
    assert (row.satisfied, row.violated, row.progress, row.key) == (False, False, 0.0, [])


# runs that go on --------------------------------------------------------------------------------------------------------------
EVALUATIONS = "sentence_id long, cell string, evaluator string, score double, error string"


def _rows(df, *names):
    return sorted([tuple(r[n] for n in names or df.columns) for r in df.collect()], key=str)


def test_a_killed_run_goes_on_and_equals_one_in_one_go(spark, tmp_path):
    sentences = spark.createDataFrame([(k, f"c{k % 4}", "x" * k) for k in range(60)] + [(None, "c0", "null key")], "sentence_id long, cell string, text string")
    old = spark.createDataFrame([(k, f"c{k % 4}", "grammar", 0.0 if k % 3 else 1.0, "disk quota" if k % 3 == 1 else None) for k in range(50)] + [(1, "c1", "form", 1.0, None)], EVALUATIONS)
    asked = []

    def score(rows):
        ids = [r.sentence_id for r in rows.collect()]
        if len(asked) == 3 and ids:
            asked.append("killed")
            raise RuntimeError("killed")
        asked.append(ids)
        return rows.select("sentence_id", "cell", F.lit("grammar").alias("evaluator"), F.length("text").cast("double").alias("score"), F.lit(None).cast("string").alias("error"))

    one, other = str(tmp_path / "one"), str(tmp_path / "other")
    rescoring.stage(one, sentences, old, "grammar")
    with pytest.raises(RuntimeError):
        rescoring.score_pieces(spark, one, score)
    before = [x for x in asked if x != "killed"]
    rescoring.stage(one, sentences.limit(0), old, "grammar")  # a run that was staged stays as it is
    assert rescoring.score_pieces(spark, one, score) == []
    assert rescoring.score_pieces(spark, one, score) == []
    scored = sorted((i for ids in asked if ids != "killed" for i in ids), key=str)
    assert scored == sorted([None, *(k for k in range(60) if k >= 50 or k % 3 == 1)], key=str) and before  # each of them once
    rescoring.stage(other, sentences, old, "grammar")
    rescoring.score_pieces(spark, other, lambda rows: score(rows))
    results = [rescoring.replaced(old, rescoring.scored(spark, p), "grammar") for p in (one, other)]
    assert _rows(results[0]) == _rows(results[1])
    kept = {(r.sentence_id, r.evaluator): r for r in results[0].collect()}
    assert kept[1, "form"].score == 1.0 and kept[1, "grammar"].score == 1.0 and kept[4, "grammar"].error is None and kept[2, "grammar"].score == 0.0


def test_all_are_scored_again_without_resume(spark, tmp_path):
    sentences = spark.createDataFrame([(1, "c", "a")], "sentence_id long, cell string, text string")
    old = spark.createDataFrame([(1, "c", "grammar", 0.5, None)], EVALUATIONS)
    for name, resume, n in (("a", True, 0), ("b", False, 1)):
        rescoring.stage(str(tmp_path / name), sentences, old, "grammar", resume)
        rescoring.score_pieces(spark, str(tmp_path / name), lambda r: r.select("sentence_id", "cell"))
        assert (rescoring.scored(spark, str(tmp_path / name)) is not None) == bool(n)


def test_roll_ups_are_refreshed_where_something_changed(spark):
    old = spark.createDataFrame([(1, "a", "g", 0.0, "quota"), (2, "a", "g", 1.0, None), (3, "b", "g", 1.0, None), (1, "a", "form", 1.0, None)], EVALUATIONS)
    fresh = spark.createDataFrame([(1, "a", "g", 0.5, None)], EVALUATIONS)
    stale = rescoring.rolled(old, ["cell"]).withColumn("mean", F.when(F.col("cell") == "b", 7.0).otherwise(F.col("mean")))  # b isn't computed again
    assert _rows(rescoring.refreshed(stale, rescoring.replaced(old, fresh, "g"), fresh, "g", ["cell"])) == [("a", "form", 1.0, 1, 0), ("a", "g", 0.75, 2, 0), ("b", "g", 7.0, 1, 0)]


def test_results_are_kept_by_content_and_errors_are_not(spark, tmp_path):
    path, asked, down = str(tmp_path / "cache"), [], {"bad"}

    def score(rows):
        got = rows.select("digest", "lang", "text").collect()
        asked.append(sorted((r.lang or "", r.text or "") for r in got))
        return spark.createDataFrame([(r.digest, float(len(r.text or "")), "503" if r.text in down else None) for r in got], "digest string, result double, error string")

    texts = spark.createDataFrame([(1, "en", "one", "x"), (2, "en", "one", "x"), (3, "cy", "one", "x"), (4, "en", "bad", "x"), (5, None, None, "x"), (6, "", "", "x")], "id long, lang string, text string, n string")
    first = _rows(rescoring.cached_results(texts, path, score), "id", "n", "result", "error", "cached")
    assert asked == [[("", ""), ("cy", "one"), ("en", "bad"), ("en", "one")]]
    assert [r[3:] for r in first] == [(None, False)] * 3 + [("503", False)] + [(None, False)] * 2
    down.clear()
    second = _rows(rescoring.cached_results(texts, path, score), "id", "result", "error", "cached")
    assert asked[1:] == [[("en", "bad")]] and [r[1:] for r in second] == [(3.0, None, True)] * 3 + [(3.0, None, False)] + [(0.0, None, True)] * 2
    assert all(r[3] for r in _rows(rescoring.cached_results(texts, path, score), "id", "result", "error", "cached")) and asked[2:] == [[]]
    assert rescoring.cached_results(texts.limit(0), path, score).count() == 0


# stored views -----------------------------------------------------------------------------------------------------------------
VIEWS = "id long, workspace_id long, position int, name string"


def _views(spark, *rows):
    return spark.createDataFrame(rows, VIEWS)


def _rearranged(spark, rows, added=(), moved=(), deleted=()):
    return views.rearranged(_views(spark, *rows), _views(spark, *added), spark.createDataFrame(moved, "id long, position int"), spark.createDataFrame(deleted, "id long, seq long"))


def test_positions_have_no_gaps(spark):
    rows = [(1, 1, 0, "a"), (2, 1, 5, "b"), (3, 1, 9, "c"), (4, 2, 3, "d")]
    got, refused = _rearranged(spark, rows, [(10, 1, None, "end"), (11, 1, 1, "second"), (12, 3, None, "first of all")], [(3, 0), (99, 1)], [(2, 1)])
    assert _rows(got) == sorted([(3, 1, 0, "c"), (1, 1, 1, "a"), (11, 1, 2, "second"), (10, 1, 3, "end"), (4, 2, 0, "d"), (12, 3, 0, "first of all")], key=str)
    assert refused.collect() == []


def test_moves_equal_a_list(spark):
    """One move puts a view where list.insert would."""
    for at in range(5):
        for to in range(5):
            ids = [20, 21, 22, 23, 24]
            got, _ = _rearranged(spark, [(i, 1, k * 3, "v") for k, i in enumerate(ids)], moved=[(ids[at], to)])
            expected = ids[:at] + ids[at + 1 :]
            expected.insert(to, ids[at])
            assert [r.id for r in got.orderBy("position").collect()] == expected
            if to not in (0, 4):
                break


def test_the_last_view_stays(spark):
    rows = [(1, 1, 0, "a"), (2, 1, 1, "b"), (3, 2, 0, "c"), (4, None, 0, "no workspace")]
    got, refused = _rearranged(spark, rows, deleted=[(1, 2), (2, 1), (3, 7), (3, 9)])
    assert _rows(got) == sorted([(1, 1, 0, "a"), (3, 2, 0, "c"), (4, None, 0, "no workspace")], key=str) and _rows(refused) == [(1, 1), (3, 2)]
    # a new view makes room for the delete of all others
    got, refused = _rearranged(spark, rows[:2], [(9, 1, None, "new")], deleted=[(1, 2), (2, 1)])
    assert _rows(got) == [(9, 1, 0, "new")] and refused.collect() == []


def test_migrations_run_once(spark):
    rows = [
        (1, "Gallery", "gallery", '{"sorts":[]}'), (2, "Gallery", "table", None), (3, "Review queue", "table", '{"query":{"learned":"not_learned","due":"due_now","tags":["x"]},"own":{"k":[1,2.5,null,true]}}'),
        (4, "All words", "table", '{"sorts":[{"field":"word","direction":"asc"}],"visibleProperties":["word","box"],"propertyOrder":["box","word","box"]}'), (5, "All words", "table", None), (6, "All words", "table", "not json"),
        (7, "All words", "table", '{"sorts":[{"field":"word","direction":"desc"}],"visibleProperties":["word"]}'), (8, "Mine", "board", '{"visibleProperties":["a","a"],"x":"y"}'), (9, None, None, "[1]"),
    ]
    first = views.migrated(spark.createDataFrame(rows, "id long, name string, layout string, config string"))
    got = {r.id: r for r in first.collect()}
    assert {i: list(r.migrations) for i, r in got.items()} == {1: ["cards"], 2: [], 3: ["review_queue"], 4: ["all_words"], 5: ["all_words"], 6: ["all_words"], 7: [], 8: ["dedupe"], 9: []}
    assert got[1].name == "Cards" and got[1].config == '{"sorts":[]}' and got[2].name == "Gallery" and got[9].config == "[1]" and got[7].config == rows[6][3]
    new = {i: json.loads(got[i].config) for i in (3, 4, 5, 8)}
    assert new[3] == {"query": {"learned": "not_learned", "due": "due_now", "tags": ["x"], "statusMatch": "any"}, "own": {"k": [1, 2.5, None, True]}}
    assert new[4] == {"sorts": [{"field": "createdAt", "direction": "desc"}], "visibleProperties": ["word", "createdAt", "box"], "propertyOrder": ["createdAt", "box", "word"]}
    assert new[5]["visibleProperties"] == list(views.TABLE_PROPERTIES) and new[8] == {"visibleProperties": ["a"], "propertyOrder": [], "x": "y"}
    again = views.migrated(first.drop("migrations"))
    assert again.filter(F.size("migrations") > 0).collect() == [] and _rows(again.drop("migrations")) == _rows(first.drop("migrations"))


# Welsh cases ------------------------------------------------------------------------------------------------------------------
LEXICON = "lemma string, tense string, person string, surface string, notes string, place int"


def test_welsh_cells_and_their_alternatives(spark):
    every = [(lemma, t, p, f"{lemma}-{t}{p}", None, 1) for lemma in ("canu", "bod", "gwneud") for t in ("pres", "past", "imperf", "fut") for p in ("1s", "2s", "3s", "1p", "2p", "3p")]
    more = [("canu", "pres", "1s", "z", "spoken", 9), ("canu", "pres", "1s", "", "spoken", 0), ("canu", "pres", "1s", "y", "short", 2), ("canu", "pres", "1s", "z", None, 3), ("bod", "pres", "1s", "dw", "short", 5)]
    nouns = [("canu", "infin", None, "canu", None, 1), ("canu", "infin", None, "caniad", "literary", 2), ("gweld", "infin", None, "gweld", None, 1)]
    verbs = spark.createDataFrame([("canu", "cânu"), ("gweld", None), ("mynd", "mynd")], "lemma string, verbnoun string")
    got, gaps = welsh.cases(verbs, spark.createDataFrame([*every, *more, *nouns], LEXICON))
    rows = {(r.lemma, r.cell_id): r for r in got.collect()}
    assert len([k for k in rows if k[0] == "canu"]) == 42 and len(rows) == 42 + 24
    one = rows["canu", "synthetic_present_1s"]
    assert (one.gold, one.gold_alts, one.match_forms, one.aux_lemma, one.aux_gold) == ("z", "canu-pres1s|y", "z|canu-pres1s|y", "", "")
    one = rows["canu", "periphrastic_present_1s"]
    assert (one.verbnoun, one.gold, one.gold_alts, one.aux_gold, one.aux_gold_alts, one.match_forms, one.particle) == ("cânu", "cânu", "canu|caniad", "dw", "bod-pres1s", "dw|bod-pres1s|cânu|canu|caniad", "yn")
    one = rows["canu", "periphrastic_past_3p"]
    assert (one.gold, one.gold_alts, one.requires_soft_mutation, one.probed_person, one.probed_number) == ("gânu", "ganu|ganiad|cânu|canu|caniad", True, "3rd", "plural")
    lacking = _rows(gaps, "lemma", "missing")
    assert len(lacking) == 18 + 1 and ("mynd", "infin") in lacking and ("gweld", "gweld/pres/1s") in lacking


# paradigms --------------------------------------------------------------------------------------------------------------------
def test_first_reason_against_a_paradigm(spark):
    regular = {name: f"habl{k}".translate(str.maketrans("0123456789", "abcdefghij")) for k, name in enumerate(forms.PARADIGM)}
    cases = [
        ("hablar", "hablado", {}, "ok"), ("claro", "hablado", {}, "noun_adj_like"), ("chantajear", None, {}, "noun_adj_like"), ("comer", "comido", {"preterite/1st/singular": "comía"}, "bad_preterite_1sg"),
        ("comer", "comido", {"preterite/1st/singular": None}, "bad_preterite_1sg"), ("comer", None, {}, "bad_participle"), ("comer", "comi do", {}, "bad_participle"), ("comer", "Junto", {}, "bad_participle_surface:Junto"), ("comer", "comer", {}, "bad_participle_surface:comer"),
        ("comer", "roto", {"present/3rd/plural": "", "preterite/2nd/singular": "a1"}, "missing:present/3rd/plural"), ("comer", "hecho", {"preterite/2nd/singular": "a1"}, "junk_form:preterite/2nd/singular:a1"),
        ("nacer", "nacido", {"future/1st/plural": "nacachamos"}, "verbecc_garbage:nacachamos"), ("cachcer", "nacido", {"future/1st/plural": "nacachamos"}, "ok"), ("hablo", "hablado", {"present/1st/singular": "hablo"}, "present_1sg_eq_infinitive"),
        ("podrir", "podrido", {}, "bad_stem_change_preterite"), ("x", "xado", {"preterite/1st/singular": "podrí", "present/1st/singular": "pudro"}, "bad_stem_change_preterite"), (None, "hablado", {}, "ok"),
    ]
    df = spark.createDataFrame([(v, p, {**regular, **c}, r) for v, p, c, r in cases], "verb string, participle string, cells map<string, string>, want string")
    got = df.select(forms.paradigm_reason(F.col("verb"), F.col("participle"), F.col("cells"), ("claro",)).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
    assert df.select(forms.paradigm_reason(F.col("verb"), F.col("participle"), F.lit(None).cast("map<string, string>"))).first()[0] == "bad_preterite_1sg"
