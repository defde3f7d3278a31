"""Streams fed piece by piece, and how often a processor asks the state."""

from pathlib import Path

from pyspark.sql import Row

from catalog import streams as ST
from catalog.base import Tables
from cloakwork.functions.surrogates import Surrogates
from cloakwork.streaming import restore as SR
from cloakwork.streaming import scopes as SS


class State(dict):
    """A map state that counts what it is asked."""

    calls = 0

    def _count(self):
        self.calls += 1

    def containsKey(self, k):
        self._count()
        return k in self

    def getValue(self, k):
        self._count()
        return self[k]

    def updateValue(self, k, v):
        self._count()
        self[k] = v

    def removeKey(self, k):
        self._count()
        del self[k]


def test_a_piece_is_one_batch_of_many_files(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    feed = ST.as_batches(t, spark.range(0, 300, 1, 4), "id")
    seen = []

    def start(stream):
        def take(df, epoch):
            seen.append((epoch, sorted(r.id for r in df.collect())))
        return stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{feed.path}-cp").trigger(availableNow=True).start()

    feed.run(start)
    assert seen == [(i, list(range(i * 100, i * 100 + 100))) for i in range(3)]
    assert len(list(Path(feed.path).glob("*.parquet"))) > 3


def test_scope_memory_asks_the_state_once_a_value():
    p = SS._ScopeMemory(None)
    p.seen = State()
    batch = [Row(scope="s", turn=t, value=v) for t in range(9, -1, -1) for v in ("a", "b")] + [Row(scope="s", turn=20, value="a")]
    out = list(p.handleInputRows(("s",), iter(batch), None))
    assert len(out) == 21 and sum(r.new for r in out) == 2 and p.seen == {("a",): (0,), ("b",): (0,)}
    assert p.seen.calls == 4
    again = list(p.handleInputRows(("s",), iter([Row(scope="s", turn=5, value="a")] * 50), None))
    assert {tuple(r) for r in again} == {("s", "a", 0, False)} and p.seen.calls == 6


def test_restore_asks_the_state_once_a_fragment_and_token():
    sur = Surrogates("k")
    token = f"{sur.prefix}SECRET_" + "0" * 32
    p = SR._StreamRestorer(sur, "all")
    p.init(type("Handle", (), {"getMapState": lambda self, *a: State()})())
    p.handleInitialState(("s",), Row(stream_id="s", token=token, value="v", layer="detected"), None)
    text = f"say {token} and {token}. " * 20
    rows = [Row(fragment="f", seq=i, kind="text", text=c, stop=i == len(text) - 1, layer=None) for i, c in enumerate(text)]
    p.entries.calls = 0
    out = list(p.handleInputRows(("s",), iter(reversed(rows)), None))
    assert "".join(r.text for r in out) == text.replace(token, "v") and sum(r.residuals for r in out) == 0
    assert p.tails == {} and p.tails.calls + p.counted.calls + p.entries.calls <= 6
