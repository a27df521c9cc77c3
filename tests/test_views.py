"""Views over a stream of puts and removals equal those of the table of all changes; state expires."""

import datetime
import random

import pytest

from lodestone.streaming import views

BASE = "key string, id string, op string, ts timestamp, "
KINDS = {
    views.Pages: (BASE + "p string, o string, confidence double", lambda r: (f"kc:{r.choice('abc')}", f"o{r.randrange(5)}", r.random()), views.pages_now),
    views.Centroids: (BASE + "v array<double>", lambda r: ([r.uniform(-1, 1), r.uniform(-1, 1)],), views.centroids_now),
    views.Scores: (BASE + "n_violations int", lambda r: (r.choice([0, 0, 1, 3]),), views.scores_now),
}
T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def run(spark, folder, schema, view, batches, keep=None, late="1 hour"):
    """The last row of each key after each batch."""
    out, state = [], {}
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        rows = []
        query = views.follow(stream, view, late, keep).writeStream.outputMode("update").foreachBatch(lambda d, _: rows.extend(d.collect())).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        state |= {r.key: tuple(r) for r in rows}
        out.append((i, dict(state)))
    return out


@pytest.fixture
def settings(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@pytest.mark.parametrize("view", KINDS)
def test_stream_equals_table(spark, settings, tmp_path, view):
    schema, value, now = KINDS[view]
    r = random.Random(view.__name__)
    batches, at = [], 0
    for _ in range(3):
        batch = []
        for _ in range(25):
            at += 1
            batch.append((f"k{r.randrange(4)}", f"i{r.randrange(8)}", r.choice(["put", "put", "remove"]), T0 + datetime.timedelta(seconds=at), *value(r)))
        batches.append(batch)
    batches.append([(f"k{k}", f"i{i}", "remove", T0 + datetime.timedelta(seconds=at + 1), *value(r)) for k in (0, 1) for i in range(8)])
    for i, state in run(spark, tmp_path, schema, view, batches):
        want = {x.key: tuple(x) for x in now(spark.createDataFrame([c for b in batches[: i + 1] for c in b], schema)).collect()}
        alive = {k: v for k, v in state.items() if v[1]}
        assert alive.keys() == want.keys()
        for k, v in alive.items():
            assert v == tuple(pytest.approx(x, abs=2e-6) if isinstance(x, (float, list)) else x for x in want[k])
    assert not {"k0", "k1"} & alive.keys() and state["k0"][1] == 0


def test_state_expires(spark, settings, tmp_path):
    schema, value, _ = KINDS[views.Scores]
    hour = lambda h: T0 + datetime.timedelta(hours=h)
    batches = [[("a", "1", "put", hour(0), 1), ("b", "1", "put", hour(0), 0)], [("b", "2", "put", hour(5), 1)], [("c", "1", "put", hour(9), 0)], [("a", "2", "put", hour(9), 0)]]
    states = dict(run(spark, tmp_path, schema, views.Scores, batches, keep="3 hours", late="10 minutes"))
    assert states[0] == {"a": ("a", 1, 1, 0.0), "b": ("b", 1, 0, 1.0)}
    assert states[2]["a"] == ("a", 0, 0, None)  # retracted once the watermark has passed its hours
    assert states[3]["a"] == ("a", 1, 0, 1.0)  # and begun anew, without what was there
    assert states[1]["b"] == ("b", 2, 1, 0.5)
