"""Exact admission control over a long log: a limit for all, a limit for each client, and a bounded table of clients.

A hit is refused as "busy" if as many hits were admitted within the window before it as all clients may have together;
then it is refused as "client" if its own client has had as many as one may have. Hits exactly as old as the window still
count. Only hits that are not "busy" touch their client; of the clients, those touched last are known, and a client that
falls out of that table is forgotten with its hits.

What happens to a hit depends on all before it, but only through a state of bounded size: the admitted hits within the
window, and of the clients those touched since the first of these was. So the log is cut into ranges of equal length.
All are run at once from a guess, each from the end that the range before it reached in the last round; a range is run
again only if what it began with has proved wrong. As old hits drop out of the window, wrong guesses are often forgotten
soon, and two or three rounds do. Where hits are so many that the gate is busy nearly all the time, it never forgets when
it began; so when a round leaves more than half of what the round before it left, the ranges are run one after the other,
each once, from ends that are final. All rounds together thus run no more than four times the ranges, and the outcomes are
one more.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sumforge.operators.ranges import scanned
from sumforge.operators.work import written

ADMITTED, BUSY, CLIENT = "admitted", "busy", "client"
#: Hits in a range: the least, and the most, which bounds what a task holds; in between, a log has RANGES ranges.
RANGE, LONGEST, RANGES = 50_000, 500_000, 64


@dataclass
class Limits:
    """seconds of the window; hits of one client and of all clients in it; clients that are known at once."""

    seconds: float = 60
    per_client: int = 30
    overall: int = 300
    clients: int = 4096

    @property
    def micros(self) -> int:
        return round(self.seconds * 1_000_000)


@dataclass
class Gate:
    """The state: times (in microseconds) of all admitted hits, and of each known client, in the order of their last touch."""

    limits: Limits
    overall: deque = field(default_factory=deque)
    known: OrderedDict = field(default_factory=OrderedDict)

    def _trim(self, times: deque, now: int) -> None:
        while times and now - times[0] > self.limits.micros:
            times.popleft()

    def decide(self, client, now: int) -> str:
        self._trim(self.overall, now)
        if len(self.overall) >= self.limits.overall:
            return BUSY
        own = self.known.pop(client, None)
        if own is None:
            own = deque()
            while len(self.known) >= max(1, self.limits.clients):
                self.known.popitem(last=False)
        self.known[client] = own
        self._trim(own, now)
        if len(own) >= self.limits.per_client:
            return CLIENT
        own.append(now)
        self.overall.append(now)
        return ADMITTED

    def run(self, clients: np.ndarray, times: np.ndarray) -> list[str]:
        """decide() of hits in the order of time; hits that can only be "busy" are passed over at once."""
        out, k, micros = [BUSY] * len(times), 0, self.limits.micros
        at = times.tolist()
        while k < len(at):
            outcome = self.decide(clients[k], at[k])
            if outcome != BUSY:
                out[k] = outcome
                k += 1
            elif not self.overall:  # no hit is ever let in
                break
            else:
                k = int(np.searchsorted(times, self.overall[0] + micros, "right"))
        return out

    def state(self, now: int) -> tuple:
        """All that can still matter at now or later: equal states decide alike from then on."""
        self._trim(self.overall, now)
        for own in self.known.values():
            self._trim(own, now)
        known = list(self.known.items())
        first = next((k for k, (_, own) in enumerate(known) if own), len(known))
        return tuple(self.overall), tuple((c, tuple(own)) for c, own in known[first:])

    @classmethod
    def of(cls, limits: Limits, state: tuple) -> Gate:
        overall, known = state or ((), ())
        return cls(limits, deque(overall), OrderedDict((c, deque(own)) for c, own in known))


def admitted(events: DataFrame, limits: Limits = Limits(), *, id_col: str = "event_id", client_col: str = "user_id", time_col: str = "ts", size: int | None = None) -> DataFrame:  # noqa: B008
    """(id, client, outcome) of each event: in the order of time, then id. Events without a time come first, all at one moment long ago.

    A task runs one range of size events (None: as many as suit the log). To the driver comes of each range the state that it ends with, which holds as
    many hits as all clients may have and as many clients as are known at once, at most. A null client is one like any other.
    """
    moment = F.coalesce(F.unix_micros(F.col(time_col).cast("timestamp")), F.lit(-(2**60)))
    rows = events.select(F.col(id_col).alias("id"), F.col(client_col).alias("client"), moment.alias("at"))
    if size is None:
        size = min(LONGEST, max(RANGE, events.count() // RANGES))
    rows = scanned(rows, [], ["at", "id"], at="n").withColumn("range", F.floor((F.col("n") - 1) / size).cast("long"))
    rows = written(rows, "hits")
    starts: dict[int, tuple] = {}
    firsts = {r["range"]: r["at"] for r in rows.groupBy("range").agg(F.min("at").alias("at")).collect()}
    gates, limited = limits, rows.schema["client"].dataType.simpleString()

    def run(begin: dict[int, tuple]):
        def ends(pdf: pd.DataFrame) -> pd.DataFrame:
            here = int(pdf["range"].iloc[0])
            gate = Gate.of(gates, begin.get(here, ()))
            gate.run(*_hits(pdf))
            overall, known = gate.state(firsts.get(here + 1, 2**62))
            return pd.DataFrame({"range": [here], "overall": [list(overall)], "clients": [[c for c, _ in known]], "times": [[list(own) for _, own in known]]})

        return ends

    schema = f"range long, overall array<long>, clients array<{limited}>, times array<array<long>>"
    todo, wrong, left = sorted(firsts), set(), 2 * len(firsts)
    while todo:
        some = rows if len(todo) == len(firsts) else rows.where(F.col("range").isin(todo))
        found = some.groupBy("range").applyInPandas(run(dict(starts)), schema).collect()
        wrong -= {*todo}
        for r in found:
            after, state = r["range"] + 1, (tuple(r["overall"]), tuple((c, tuple(own)) for c, own in zip(r["clients"], r["times"], strict=True)))
            if after in firsts and starts.get(after, ((), ())) != state:
                starts[after] = state
                wrong.add(after)
        left = len(wrong) if 2 * len(wrong) <= left else 0  # 0: one after the other from now on
        todo = sorted(wrong) if left else sorted(wrong)[:1]

    def outcomes(pdf: pd.DataFrame) -> pd.DataFrame:
        gate = Gate.of(gates, starts.get(int(pdf["range"].iloc[0]), ()))
        pdf = pdf.sort_values("n")
        return pd.DataFrame({"id": pdf["id"], "client": pdf["client"], "outcome": gate.run(*_hits(pdf))})

    done = rows.groupBy("range").applyInPandas(outcomes, f"id {rows.schema['id'].dataType.simpleString()}, client {limited}, outcome string")
    return done.withColumnsRenamed({"id": id_col, "client": client_col})


def _hits(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("n")
    return pdf["client"].astype(object).where(pdf["client"].notna(), None).to_numpy(), pdf["at"].to_numpy()


def admitted_stream(events: DataFrame, limits: Limits = Limits(), *, id_col: str = "event_id", client_col: str = "user_id", time_col: str = "ts", delay: str = "1 minute") -> DataFrame:  # noqa: B008
    """admitted() for a stream, one gate for all: hits are decided in the order of time within a micro-batch, and batch after batch.

    The gate's state is as small as that of a range, and goes when the watermark has passed the window after its last hit.
    Rows behind the watermark are late, and dropped.
    """
    spark_types = dict(events.dtypes)
    gates = limits

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        overall, clients, times = state.get if state.exists else ([], [], [])
        gate = Gate.of(gates, (tuple(overall), tuple((c, tuple(own)) for c, own in zip(clients, times, strict=True))))
        pdf = pd.concat(list(batches)).sort_values(["at", "id"])
        outcome = [gate.decide(c, t) for c, t in zip(pdf["client"].astype(object).where(pdf["client"].notna(), None), pdf["at"], strict=True)]
        last = int(pdf["at"].iloc[-1])
        overall, known = gate.state(last)
        state.update((list(overall), [c for c, _ in known], [list(own) for _, own in known]))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (last + gates.micros) // 1000 + 1))
        yield pd.DataFrame({"id": pdf["id"], "client": pdf["client"], "outcome": outcome})

    rows = events.withWatermark(time_col, delay).select(F.col(id_col).alias("id"), F.col(client_col).alias("client"), F.col(time_col), F.unix_micros(F.col(time_col).cast("timestamp")).alias("at"), F.lit(0).alias("gate"))
    out, held = f"id {spark_types[id_col]}, client {spark_types[client_col]}, outcome string", f"overall array<long>, clients array<{spark_types[client_col]}>, times array<array<long>>"
    done = rows.groupBy("gate").applyInPandasWithState(run, out, held, "append", GroupStateTimeout.EventTimeTimeout)
    return done.withColumnsRenamed({"id": id_col, "client": client_col})
