"""A folder is registered once by content, however often it is scanned."""

from __future__ import annotations

import itertools
import json
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from lectern.streaming import gate, ingest, settle


def test_rescan_registers_each_content_once(spark, tmp_path):
    root, table, marks = tmp_path / "lib", str(tmp_path / "table"), str(tmp_path / "marks")
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("one")
    (root / "sub" / "b.md").write_text("two")
    (root / "skip.bin").write_bytes(b"\0")
    ingest.register_stream(ingest.watch(spark, str(root)), table, marks).awaitTermination()
    assert spark.read.parquet(table).count() == 2
    (root / "copy.txt").write_text("one")
    (root / "c.txt").write_text("three")
    ingest.register_stream(ingest.watch(spark, str(root)), table, marks).awaitTermination()
    assert sorted(r.kind for r in spark.read.parquet(table).collect()) == ["markdown", "text", "text"]


def test_stream_and_table_count_alike(spark, tmp_path):
    events = spark.range(50).selectExpr("id AS event_id", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id, 0) AS ts", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS event_type", "CAST(id AS double) AS value")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    query = ingest.live_counts(stream).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = sorted(map(tuple, ingest.live_counts(events).collect()))
    assert sorted(map(tuple, spark.sql("SELECT * FROM live").collect())) == want


@pytest.fixture
def stateful(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    settle.with_state_store(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def _events(spark, folder):
    return spark.readStream.schema("path string").json(str(folder))


def test_growing_settled_and_vanished_files(stateful, tmp_path):
    """One file grows for some seconds, one is whole, one goes away, one stays empty, one never stops."""
    root, events = tmp_path / "files", tmp_path / "events"
    root.mkdir()
    events.mkdir()
    (root / "whole.pdf").write_bytes(b"complete")
    (root / "gone.pdf").write_bytes(b"x")
    (root / "empty.pdf").write_bytes(b"")
    for name in ("growing.pdf", "endless.pdf"):
        (root / name).write_bytes(b"part")
    stop = threading.Event()

    def grow():
        for k in itertools.count():
            for name in ("growing.pdf", "endless.pdf") if k < 60 else ("endless.pdf",):
                with (root / name).open("ab") as f:
                    f.write(b"more")
            if stop.wait(0.1):
                return

    writer = threading.Thread(target=grow)
    writer.start()
    found = settle.settled_files(_events(stateful, events), debounce=1, poll=1, tries=8)
    query = found.writeStream.format("memory").queryName("settled").option("checkpointLocation", str(tmp_path / "marks")).trigger(processingTime="500 milliseconds").start()
    try:
        names = ["whole", "gone", "empty", "growing", "endless"]
        (events / "a.json").write_text("".join(json.dumps({"path": str(root / f"{n}.pdf")}) + "\n" for n in [*names, "whole"]))
        (root / "gone.pdf").unlink()
        seen, until = [], time.time() + 90
        while len(seen) < 5 and time.time() < until:
            time.sleep(0.5)
            seen = stateful.sql("SELECT * FROM settled").collect()
    finally:
        stop.set()
        writer.join()
        query.stop()
    by = {r.path.rpartition("/")[2].removesuffix(".pdf"): r for r in seen}
    assert {n: r.outcome for n, r in by.items()} == {"whole": "settled", "gone": "vanished", "empty": "given up", "growing": "settled", "endless": "given up"}
    assert by["growing"].size == (root / "growing.pdf").stat().st_size and by["whole"].tries == 2
    assert by["endless"].tries == by["empty"].tries == 8


def test_a_change_moves_the_deadline(stateful, tmp_path):
    events = tmp_path / "events"
    events.mkdir()
    (tmp_path / "a.pdf").write_bytes(b"1")
    found = settle.settled_files(_events(stateful, events), debounce=8, poll=0.5)
    query = found.writeStream.format("memory").queryName("moved").option("checkpointLocation", str(tmp_path / "marks")).trigger(processingTime="500 milliseconds").start()
    try:
        last = 0.0
        for k in range(3):
            (events / f"{k}.json").write_text(json.dumps({"path": str(tmp_path / "a.pdf")}) + "\n")
            last = time.time()
            time.sleep(4)
        until = time.time() + 60
        while not stateful.sql("SELECT * FROM moved").collect() and time.time() < until:
            time.sleep(0.3)
        assert time.time() - last >= 8 and stateful.sql("SELECT * FROM moved").count() == 1
    finally:
        query.stop()


def test_sizes_are_judged_as_they_come():
    def run(sizes, most=30):
        before = None
        for tries, size in enumerate(sizes, 1):
            if outcome := settle.judged(size, before, tries, most):
                return outcome, tries
            before = size
        return None

    assert run([5, 5]) == ("settled", 2)
    assert run([1, 2, 3, 3]) == ("settled", 4)
    assert run([0, 0, 0, 4, 4]) == ("settled", 5)
    assert run([3, None]) == ("vanished", 2)
    assert run(range(1, 99)) == ("given up", 30)


ANSWERS = ["see [#8] and [#99]; [not] a [#mark, [#] or [[#7]] here [#12", "[#7][#8][#9]", "plain", "", "[", "ends [#", "a[#1234567]b[#123456789012345678]c[#1234567890123456789]d"]


def test_any_cut_passes_the_gate_alike(spark):
    """Every way of holding back gives the whole answer's text and ids, which are those of the batch gate."""
    from lectern.operators.search import cited

    rng = random.Random(5)
    allowed = {7, 8, 1234567}
    for text in ANSWERS:
        want = gate.checked(text, allowed)
        for _ in range(300):
            cuts = sorted(rng.choices(range(len(text) + 1), k=rng.randint(0, 8)))
            pending, shown, kept, refused = "", "", [], []
            for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
                pending += text[a:b]
                at = gate.held_from(pending) if b < len(text) else len(pending)
                assert len(pending) - at <= gate.MOST_DIGITS + 2
                x, y, z = gate.checked(pending[:at], allowed)
                pending, shown, kept, refused = pending[at:], shown + x, kept + y, refused + z
            assert (shown, kept, refused) == want
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(ANSWERS[:5])], "k int, answer string")
    for r in cited(rows, "answer", F.array(*[F.lit(x).cast("long") for x in sorted(allowed)])).collect():
        clean, kept, refused = gate.checked(r.answer, allowed)
        assert (r.clean_text, r.cited, r.refused) == (clean, list(dict.fromkeys(kept)), list(dict.fromkeys(refused)))


def test_streamed_answers_equal_whole_ones(stateful, tmp_path):
    rng = random.Random(9)
    root = tmp_path / "tokens"
    root.mkdir()
    batches = [[], [], [], []]
    for k, text in enumerate(ANSWERS):
        cuts = sorted(rng.sample(range(len(text) + 1), min(3, len(text))))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        for place, part in enumerate(parts):
            batches[min(place, 3)].append({"answer": str(k), "place": place, "token": part, "allowed": [7, 8] if place == 0 else None, "last": place == len(parts) - 1})
    schema = "answer string, place long, token string, allowed array<long>, last boolean"
    stream = gate.gated(stateful.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(root)))
    for k, batch in enumerate(batches):
        (root / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in batch))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start()
        query.awaitTermination()
    found = {}
    for r in stateful.read.parquet(str(tmp_path / "out")).orderBy("answer", "place").collect():
        text, kept, refused = found.get(r.answer, ("", [], []))
        found[r.answer] = (text + r.text, kept + list(r.cited), refused + list(r.refused))
    assert found == {str(k): gate.checked(t, {7, 8}) for k, t in enumerate(ANSWERS)}
