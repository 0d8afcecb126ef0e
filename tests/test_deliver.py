"""The event sink with a receiver that fails."""

import json
import os
import tempfile

import pytest

from opsweave.sources import sinks as S


def receiver(folder, failures):
    """Keeps a parcel as one file; the first ``failures`` attempts of every third parcel fail, one after it was kept."""

    def send(parcel, rows):
        tries = f"{folder}/{parcel}.tries"
        n = len(open(tries).read()) if os.path.exists(tries) else 0
        with open(tries, "a") as f:
            f.write("x")
        bad = int(parcel.split("-")[1]) % 3 == 0 and n < failures
        if not bad or n == 1:
            with open(f"{folder}/{parcel}.json", "w") as f:
                json.dump([r["event_id"] for r in rows], f)
        if bad:
            raise OSError("receiver is down")

    return send


def kept(folder):
    return {n[:-5]: json.load(open(f"{folder}/{n}")) for n in os.listdir(folder) if n.endswith(".json")}


def tries(folder):
    return {n[:-6]: os.path.getsize(f"{folder}/{n}") for n in os.listdir(folder) if n.endswith(".tries")}


@pytest.fixture
def folder():
    f = tempfile.mkdtemp(prefix="opsweave-deliver-")
    os.makedirs(f"{f}/got")
    return f


def test_failing_deliveries_lose_and_repeat_nothing(spark, folder):
    schema = "event_id long, t double, detail string"
    for b in range(3):
        rows = [(b * 100 + i, float((i * 37) % 100), None if i % 9 == 0 else f"d{i}") for i in range(67)]
        spark.createDataFrame(rows, schema).repartition(3).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    send = receiver(f"{folder}/got", 2)
    go = S.deliver(spark, f"{folder}/sink", send, ["t", "event_id"], size=10)
    assert S.undelivered(spark, f"{folder}/sink") is None and S.redeliver(spark, f"{folder}/sink", send) == 0
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = stream.writeStream.foreachBatch(go).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    waiting = S.undelivered(spark, f"{folder}/sink").collect()
    assert waiting and {r.error for r in waiting} == {"OSError: receiver is down"}  # of the last two micro-batches
    assert {r.parcel.split("-")[0] for r in waiting} == {"1", "2"}
    left = [S.redeliver(spark, f"{folder}/sink", send) for _ in range(3)]
    assert left[0] > 0 and left[1:] == [0, 0]
    got = kept(f"{folder}/got")
    assert sorted(x for ids in got.values() for x in ids) == sorted(b * 100 + i for b in range(3) for i in range(67))
    assert max(len(ids) for ids in got.values()) == 10
    assert {p: n for p, n in tries(f"{folder}/got").items() if n > 1} == {p: 3 for p in got if int(p.split("-")[1]) % 3 == 0}


def test_replayed_micro_batches(spark, folder):
    batch = spark.createDataFrame([(i, float(i % 4)) for i in range(25)], "event_id long, t double")
    send = receiver(f"{folder}/got", 0)
    S.deliver(spark, f"{folder}/sink", send, ["t", "event_id"], size=10)(batch, 0)
    first, n = kept(f"{folder}/got"), tries(f"{folder}/got")
    S.deliver(spark, f"{folder}/sink", send, ["t", "event_id"], size=10)(batch, 0)  # its outcome stands
    assert tries(f"{folder}/got") == n
    # the outcome was lost before it stood: the same parcels go out again
    S.deliver(spark, f"{folder}/other", send, ["t", "event_id"], size=10)(batch.repartition(7), 0)
    assert kept(f"{folder}/got") == first and tries(f"{folder}/got") == {p: 2 for p in n}
    S.deliver(spark, f"{folder}/sink", send, ["t", "event_id"], size=10)(batch.where("false"), 1)
    assert S.undelivered(spark, f"{folder}/sink").count() == 0
