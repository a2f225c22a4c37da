"""Streams against the batch operators over the same events."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import automata
from lexiloom.operators import mastery
from lexiloom.streaming import enrichment, tracker, upsert
from lexiloom.streaming.mastery import fold_stream

SCHEMA = "vocab_id long, ts timestamp, event_id long, outcome string"
START = datetime(2024, 1, 1)


def _events(n=400):
    kinds = ["correct", "incorrect", "hinted", "skipped", "correct", "correct", "odd"]
    return [(k % 7, START + timedelta(minutes=k), k, kinds[(k * k + k // 3) % 7]) for k in range(n)]


def _write(spark, rows, path, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def _run(stream, table, checkpoint, key="vocab_id", order="seen"):
    query = stream.writeStream.outputMode("update").foreachBatch(upsert.upsert_into(table, [key], order, buckets=4)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def test_late_events_are_folded_in_their_place(spark, tmp_path):
    """Batches out of order within the delay, a null key and rows without a time, three runs of one query, each after a restart."""
    events = [*_events(), *[(None, START + timedelta(minutes=7 * k), 1000 + k, "correct") for k in range(30)]]
    odd = [(3, None, 2000, "correct"), (99, None, 2001, "incorrect")]
    source, table = str(tmp_path / "in"), str(tmp_path / "states")
    expected = {r.vocab_id: r for r in mastery.fold(spark.createDataFrame([*events, *odd], SCHEMA)).collect()}
    assert 99 not in expected and None in expected
    events.sort(key=lambda e: e[1])
    rnd = random.Random(5)
    shuffled = sorted(events, key=lambda e: e[1] + timedelta(minutes=rnd.uniform(0, 50)))  # late by less than an hour
    last = [(-1, START + timedelta(days=9), 3000, "skipped")]
    for part in (shuffled[:150] + odd, shuffled[150:151], shuffled[151:], last):
        _write(spark, part, source)
        stream = fold_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), delay="1 hour")
        _run(stream.withColumn("seen", F.col("last")), table, str(tmp_path / "c"))
    got = {r.vocab_id: r for r in upsert.latest(table, spark).collect()}
    got.pop(-1, None)
    assert got.keys() == expected.keys()
    for k, e in expected.items():
        assert {c: got[k][c] for c in e.asDict()} == e.asDict()


def test_events_in_one_batch_wait_for_the_watermark(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "states")
    _write(spark, [(1, START, 1, "correct"), (1, START + timedelta(hours=3), 2, "correct"), (2, START + timedelta(hours=3), 3, "correct")], source)
    _run(fold_stream(spark.readStream.schema(SCHEMA).parquet(source), delay="2 hours").withColumn("seen", F.col("last")), table, str(tmp_path / "c"))
    assert [(r.vocab_id, r.box) for r in upsert.latest(table, spark).collect()] == [(1, 1)]


# tables that batches are merged into ------------------------------------------------------------------------------------------
def _frame(spark, *rows):
    return spark.createDataFrame(rows, "k int, v int, t string")


def _have(spark, table):
    return sorted(map(tuple, upsert.latest(table, spark).collect()), key=str)


def test_upsert_keeps_the_order_across_batches(spark, tmp_path):
    table = str(tmp_path / "t")
    assert upsert.latest(table, spark) is None
    assert upsert.upsert(table, _frame(spark, (1, 1, "a"), (1, 2, "b"), (2, 2, "c"), (None, 1, "n")), ["k"], "v", "s", 0)
    assert upsert.upsert(table, _frame(spark, (2, 1, "older"), (3, 1, "d"), (None, 2, "m"), (1, None, "no order"), (3, None, "none")), ["k"], "v", "s", 1)
    expected = sorted([(1, 2, "b"), (2, 2, "c"), (3, 1, "d"), (None, 2, "m")], key=str)
    assert _have(spark, table) == expected
    upsert.upsert(table, _frame(spark, (2, 2, "same order, newer batch")), ["k"], "v", "s", 2)
    assert (2, 2, "same order, newer batch") in _have(spark, table)


def test_upsert_is_the_same_when_a_batch_runs_again(spark, tmp_path):
    table = str(tmp_path / "t")
    upsert.upsert(table, _frame(spark, (1, 1, "a"), (2, 1, "b")), ["k"], "v", "s", 0)
    was = _have(spark, table)
    for again in (True, False, False):
        assert upsert.upsert(table, _frame(spark, (2, 5, "c"), (3, 1, "d")), ["k"], "v", "s", 1) is again
        assert _have(spark, table) == [(1, 1, "a"), (2, 5, "c"), (3, 1, "d")]
    assert sorted(map(tuple, upsert.before(table, spark, "s", 1).collect())) == was
    # another stream, as after a new checkpoint folder, begins at 0 and is seen
    assert upsert.upsert(table, _frame(spark, (9, 1, "z")), ["k"], "v", "other", 0)
    assert (9, 1, "z") in _have(spark, table)


def test_a_batch_that_failed_before_it_was_published_leaves_no_trace(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "t")
    upsert.upsert(table, _frame(spark, (1, 1, "a")), ["k"], "v", "s", 0)
    with monkeypatch.context() as m:
        m.setattr(upsert._Files, "publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            upsert.upsert(table, _frame(spark, (1, 7, "half"), (5, 1, "half")), ["k"], "v", "s", 1)
    assert _have(spark, table) == [(1, 1, "a")]
    upsert.upsert(table, _frame(spark, (1, 8, "whole")), ["k"], "v", "s", 1)
    assert _have(spark, table) == [(1, 8, "whole")]


def test_only_touched_buckets_are_written_and_old_versions_go(spark, tmp_path):
    table, path = str(tmp_path / "t"), tmp_path / "t"
    upsert.upsert(table, _frame(spark, *[(k, 1, "a") for k in range(200)]), ["k"], "v", buckets=8)
    for n in range(1, 5):
        upsert.upsert(table, _frame(spark, (7, 1 + n, "b")), ["k"], "v")
        assert len([p for p in (path / "data" / str(n)).iterdir() if p.name.startswith("bucket=")]) == 1
    assert sorted(int(p.stem) for p in (path / "versions").glob("[0-9]*.json")) == [3, 4]
    assert sorted(int(p.name) for p in (path / "data").iterdir()) == [0, 3, 4]
    assert len(_have(spark, table)) == 200 and (7, 5, "b") in _have(spark, table)


def test_keys_that_go_and_a_batch_of_one_key(spark, tmp_path):
    table = str(tmp_path / "t")
    upsert.upsert(table, _frame(spark, *[(1, k, "x") for k in range(500)], (2, 1, "y"), (None, 1, "n")), ["k"], "v")
    assert _have(spark, table) == sorted([(1, 499, "x"), (2, 1, "y"), (None, 1, "n")], key=str)
    upsert.upsert(table, _frame(spark, (3, 1, "z")), ["k"], "v", gone=spark.createDataFrame([(2,), (None,)], "k int"))
    assert _have(spark, table) == [(1, 499, "x"), (3, 1, "z")]
    upsert.upsert(table, _frame(spark).limit(0), ["k"], "v")
    assert _have(spark, table) == [(1, 499, "x"), (3, 1, "z")]


# token streams ----------------------------------------------------------------------------------------------------------------
GOLD, BANNED = [["a", "b", "a"], ["c", "c"], []], [["b", "b", "c"], ["d", "a", "d"]]


def test_tokens_in_batches_equal_the_trace(spark, tmp_path):
    rnd, schema = random.Random(3), "text_id long, at long, token string, gold array<array<string>>, banned array<array<string>>"
    texts = {k: [rnd.choice(["a", "b", "c", "d", None]) for _ in range(rnd.randint(1, 40))] for k in range(12)}
    rows = [(k, i, t, GOLD, BANNED if k % 3 else None) for k, tokens in texts.items() for i, t in enumerate(tokens)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for low, high in ((0, 5), (5, 6), (6, 40)):
        _write(spark, [r for r in rows if low <= r[1] < high], source, schema)
        stream = tracker.track_stream(spark.readStream.schema(schema).parquet(source))
        stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("text_id", "at", "satisfied", "violated", "progress").collect())
    batch = spark.createDataFrame([(k, tokens, GOLD, BANNED if k % 3 else None) for k, tokens in texts.items()], "text_id long, tok array<string>, gold array<array<string>>, banned array<array<string>>")
    states = batch.select("text_id", "gold", F.posexplode(automata.trace(F.col("tok"), F.col("gold"), F.col("banned"))).alias("at", "s"))
    expected = sorted(tuple(r) for r in states.select("text_id", F.col("at").cast("long"), "s.satisfied", "s.violated", automata.progress(F.col("s"), F.col("gold"))).collect())
    assert got == expected


# enrichment jobs --------------------------------------------------------------------------------------------------------------
LEXEMES = "id long, language string, lemma string, pos string, gloss_primary string, tags array<string>, enrichment_status string"
RESULTS = "lexeme_id long, lemma string, pos string, tags array<string>, gloss_primary string, confidence double, error string"


def _queue(spark, path):
    lexemes = [
        (1, "es", "nadar", "other", "", [], "pending"), (2, "es", "casa", "noun", "house", ["noun"], "enriched"), (3, "es", "casa", "noun", "house", [], "pending"),
        (4, "es", "corre", "verb", "", [], "pending"), (5, "es", "correr", "verb", "to run", ["verb"], "complete"), (6, "es", "perro", "noun", "", [], "pending"),
        (7, "es", "perros", "noun", "", [], "pending"), (8, None, "x", None, None, None, "pending"),
    ]
    vocab = [(10, 1, 1), (11, 1, 3), (12, 1, 2), (13, 2, 3), (14, 1, 4), (15, 1, 6), (16, 1, 7), (17, None, None)]
    enrichment.load(path, spark.createDataFrame(lexemes, LEXEMES), spark.createDataFrame(vocab, "id long, workspace_id long, lexeme_id long"))


def _model(spark, asked, down=()):
    """What a model would say, and a note of what it was asked."""
    said = {1: ("Nadar ", "verb", ["Verb", "verb "], "To  swim"), 4: ("correr", "verb", ["verb"], "to run"), 6: ("perro", "noun", ["noun"], "dog"), 7: ("perro", "noun", ["noun"], "dog"), 8: ("x", "noun", ["noun"], "x")}

    def enrich(lexemes):
        ids = sorted(r.id for r in lexemes.select("id").collect())
        if ids:
            asked.append(ids)
        rows = [(i, *said[i], 0.9, "timeout" if i in down else None) for i in ids]
        return spark.createDataFrame(rows, RESULTS)

    return enrich


def _tables(spark, path):
    out = {t: upsert.latest(f"{path}/{t}", spark) for t in enrichment.TABLES}
    return {t: sorted([tuple(r) for r in df.select(*[c for c in df.columns if c != "version"]).collect()], key=str) for t, df in out.items()}


def test_enrichment_stream_and_its_replay(spark, tmp_path, monkeypatch):
    path, asked = str(tmp_path / "q"), []
    _queue(spark, path)
    frame = lambda *rows: spark.createDataFrame(rows, "id long, lexeme_id long, vocab_id long, status string")
    first = frame(*[(100 + i, i, None, "pending") for i in (1, 2, 3, 4, 6, 7, 9)], (99, 7, None, "pending"), (120, 1, None, "pending"), (100 + 1, 1, None, "pending"))
    write = enrichment.process_into(path, _model(spark, asked, down=[6]))
    write(first, 0)
    assert asked == [[1, 4, 6, 7]]  # the enriched one, the one with a cached sense and the missing one aren't asked for
    after = _tables(spark, path)
    jobs = {r[0]: r[3:] for r in after["jobs"]}
    assert jobs == {
        101: ("done", "model", 1, 0.9), 102: ("done", None, None, None), 103: ("done", "cache", 2, 1.0), 104: ("done", "dedupe", 5, 0.9), 106: ("pending", None, None, None),
        99: ("done", "model", 7, 0.9), 107: ("done", None, None, None), 109: ("failed", None, None, None), 120: ("done", None, None, None),
    }
    lexemes = {r[0]: r for r in after["lexemes"]}
    assert lexemes[1] == (1, "es", "nadar", "verb", "to swim", ["verb"], "enriched") and lexemes[7][2:5] == ("perro", "noun", "dog") and 3 not in lexemes and 4 not in lexemes
    assert sorted(after["vocab"], key=str) == sorted([(10, 1, 1), (12, 1, 2), (13, 2, 2), (14, 1, 5), (15, 1, 6), (16, 1, 7), (17, None, None)], key=str)
    write(first, 0)
    assert _tables(spark, path) == after

    # the second batch fails between two tables; the run after it ends as if nothing had been
    whole = str(tmp_path / "w")
    _queue(spark, whole)
    other = enrichment.process_into(whole, _model(spark, []))
    enrichment.process_into(whole, _model(spark, [], down=[6]))(first, 0)
    second = frame((108, 8, None, "pending"), (101, 1, None, "pending"))
    other(second, 1)
    real, calls = upsert.upsert, []

    def failing(where, *args, **kwargs):
        calls.append(where)
        if len(calls) == 2:
            raise OSError("lost")
        return real(where, *args, **kwargs)

    write = enrichment.process_into(path, _model(spark, asked))
    with monkeypatch.context() as m:
        m.setattr(upsert, "upsert", failing)
        with pytest.raises(OSError):
            write(second, 1)
    write(second, 1)
    assert _tables(spark, path) == _tables(spark, whole)
    jobs = {r[0]: r[3:] for r in _tables(spark, path)["jobs"]}
    assert jobs[106] == ("done", "dedupe", 7, 0.9) and jobs[108][0] == "done" and jobs[101] == ("done", "model", 1, 0.9)
